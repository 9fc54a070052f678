"""Scalar helpers: states, flags, lists, windows, URLs, labels."""

from pyspark.sql import functions as F

from meshframes.functions import scalars as sc


def _one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).first()["o"]


def test_state_names_and_codes(spark):
    df = spark.createDataFrame([(i,) for i in range(-1, 10)], "c int")
    got = [r["n"] for r in df.select(sc.state_name("c").alias("n")).collect()]
    assert got[1:9] == ["disabled", "disconnected", "connecting", "handshaking", "connected", "reconnect_wait",
                        "reconnect_wait_degraded", "stopping"]
    assert got[0] == got[9] == got[10] == "disconnected"
    assert _one(spark, sc.state_code(F.col("x")), "connected") == 4
    assert _one(spark, sc.state_code(F.col("x")), "nope") is None


def test_flags(spark):
    cases = {None: False, "": True, " 1": True, "TRUE": True, " yes ": True, "On": True, "no": False, "0": False, "2": False}
    for v, want in cases.items():
        assert _one(spark, sc.parse_flag(F.col("x")), v) is want, v


def test_csv_list(spark):
    assert _one(spark, sc.parse_csv_list(F.col("x")), " b, a,,b , c,a ") == ["b", "a", "c"]
    assert _one(spark, sc.parse_csv_list(F.col("x")), " , ") == []


def test_effective_window(spark):
    def w(req, d=300, m=3600, on=True):
        df = spark.createDataFrame([(req, d, m, on)], "r long, d long, m long, on boolean")
        return df.select(sc.effective_window("r", "d", "m", "on").alias("o")).first()["o"]

    assert w(None) == 300 and w(0) == 1 and w(99999) == 3600 and w(60) == 60
    assert w(None, d=0) == 1 and w(None, d=5000) == 3600 and w(10, m=0) == 1 and w(10, on=False) is None


def test_ascii_upper_keeps_non_ascii(spark):
    assert _one(spark, sc.ascii_upper(F.col("x")), "straße advert") == "STRAßE ADVERT"


def test_labels(spark):
    for s, label, live in [("reconnect_wait", "retrying", False), ("reconnect_wait_degraded", "degraded", False),
                           ("connected", "connected", True), ("stopping", "stopping", False)]:
        assert _one(spark, sc.state_label(F.col("x")), s) == label
        assert _one(spark, sc.is_live(F.col("x")), s) is live


def test_websocket_url(spark):
    cases = {
        "https://a.example/": "wss://a.example/ws",
        "http://a.example": "ws://a.example/ws",
        "https://a.example/x//": "wss://a.example/x/ws",
        "wss://a.example/ws": "wss://a.example/ws",
        "wss://a.example/ws/": "wss://a.example/ws/",
        "https://A.Example:443/p?q=1#frag": "wss://a.example/p/ws?q=1",
        "http://a.example:8080/p#top/ws/": "ws://a.example:8080/p/ws",
        "HTTPS://a.example/foows": "wss://a.example/foows/ws",
        "ftp://a.example/": None,
        "not a url": None,
    }
    for u, want in cases.items():
        assert _one(spark, sc.websocket_url(F.col("x")), u) == want, u


def test_kind_and_bytes(spark):
    df = spark.createDataFrame([(True, "é")], "t boolean, s string")
    r = df.select(sc.kind_of("t").alias("k"), sc.kind_of(~F.col("t")).alias("k2"), sc.payload_bytes(F.col("s").cast("binary")).alias("n")).first()
    assert (r["k"], r["k2"], r["n"]) == (1, 2, 2)


#: What the URL Standard makes of an address, with the path rule applied; null where it or the scheme rule rejects it.
URLS = {
    " https://a.b/x ": "wss://a.b/x/ws", "https:a.b": "wss://a.b/ws", "https://a.b:99999/": None, "https://a.b/x/../y": "wss://a.b/y/ws", "http://A.B:80/WS": "ws://a.b/WS/ws",
    "https://a.b:443/ws/": "wss://a.b/ws/", "http://a.b:443": "ws://a.b:443/ws", "ftp://a.b/": None, "https://": None, "http://u:p@a.b/?q=1#f": "ws://u:p@a.b/ws?q=1",
    "https://a.b/./x/%2E%2e/y/.": "wss://a.b/y/ws", "https:\\\\a.b\\c\\..\\d": "wss://a.b/d/ws", "https://a b/": None, "https://a.b/é x?é x'": "wss://a.b/%C3%A9%20x/ws?%C3%A9%20x%27",
    "ws://127.1/ws": "ws://127.0.0.1/ws", "ws://0x7f.1": "ws://127.0.0.1/ws", "ws://256.1.1.1": None, "ws://1.2.3.4.5": None, "ws://[::1]:8080/a": "ws://[::1]:8080/a/ws",
    "ht\ntp://a.b\t/x": "ws://a.b/x/ws", "https://a.b/?": "wss://a.b/ws?", "http://@a.b": "ws://a.b/ws", "http://u:@a.b": "ws://u@a.b/ws", "https://a.b:0443/": "wss://a.b/ws",
    "https://a.b:x/": None, "a.b/c": None, "": None, "https://a.b/../..": "wss://a.b/ws", "https://a%41.b/": "wss://aa.b/ws", "https://a.b//x//": "wss://a.b//x/ws",
    "https://a.b/x;y=1/%zz": "wss://a.b/x;y=1/%zz/ws", "mailto:x@y": None, "https://a.b:/": "wss://a.b/ws", "http://1e3.b": "ws://1e3.b/ws", "https://a.b/a/..": "wss://a.b/ws",
    "https://a.b/ws/../ws?x": "wss://a.b/ws?x", "HTTPS://a.b/`{}^|": "wss://a.b/%60%7B%7D%5E|/ws", "https://a.b:65535/": "wss://a.b:65535/ws", "https://a.b:65536/": None,
    "ws://4294967295": "ws://255.255.255.255/ws", "ws://4294967296": None, "ws://010.1.1.1.": "ws://8.1.1.1/ws", "https://a.b/..x/.y": "wss://a.b/..x/.y/ws", "https://x@y@z.c/": "wss://x%40y@z.c/ws",
}


def test_addresses_are_read_as_the_url_standard_reads_them(spark):
    df = spark.createDataFrame([(u,) for u in URLS] + [(None,)], "u string")
    got = {r["u"]: r["w"] for r in df.select("u", sc.websocket_url("u").alias("w")).collect()}
    assert got.pop(None) is None
    assert got == URLS
