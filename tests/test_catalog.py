"""Source catalog: build (C1), defaults (S8), validation (C2), diff (C3), listing (C4)."""

from pyspark.sql import functions as F

from meshframes.operators import catalog as cg
from meshframes.schema import DedupPolicy, NETWORKS, RelaySettings


def _networks(spark):
    a = lambda url, h=None: {"name": None, "url": url, "headers": h}
    rows = [
        (0, "prague", [a("https://p.example/"), a("https://dup.example/ws"), a("ftp://x.example/"), a("https://p2.example/x", {"A": "1"})]),
        (1, "plzen", [a("wss://dup.example/ws"), a("http://z.example/ws/"), a("https://p3.example", {})]),
        (2, "prague", [a("https://q.example/")]),
    ]
    return spark.createDataFrame(rows, NETWORKS)


def test_build_catalog_first_url_wins_and_numbering(spark):
    cat, rejected = cg.build_source_catalog(cg.flatten_networks(_networks(spark)), with_rejected=True)
    got = sorted((r["id"], r["url"], r["mapping"], bool(r["headers"])) for r in cat.collect())
    assert got == sorted([
        ("prague", "wss://p.example/ws", "prague:0", False),
        ("prague-2", "wss://dup.example/ws", "prague:1", False),
        ("prague-3", "wss://p2.example/x/ws", "prague:2", True),
        ("plzen", "ws://z.example/ws/", "plzen:0", False),
        ("plzen-2", "wss://p3.example/ws", "plzen:1", False),
        # a repeated network id restarts at 1 (numbered by position)
        ("prague", "wss://q.example/ws", "prague:0", False),
    ])
    assert [r["url"] for r in rejected.collect()] == ["ftp://x.example/"]


def test_source_defaults(spark):
    df = spark.createDataFrame([("a", "wss://a/ws")], "id string, url string")
    r = cg.with_source_defaults(df).first()
    assert r["headers"] == {} and r["disabled"] is False and r["proxy"] is None and r["mapping"] is None


def test_validation_lists_every_violation(spark):
    rows = [("a", None), ("a", None), ("", None), ("x" * 65536, None), ("b", " "), ("c", "socks5://h:1"),
            ("d", "http://"), ("e", "http://proxy:8888"), ("f", "nonsense")]
    df = spark.createDataFrame(rows, "id string, proxy string")
    got = sorted((r["id"][:5] if r["id"] else r["id"], r["rule"]) for r in cg.validate_sources(df).collect())
    assert got == sorted([("a", "duplicate_id"), ("", "empty_id"), ("xxxxx", "id_too_long"), ("b", "empty_proxy"),
                          ("c", "proxy_not_http"), ("d", "proxy_without_host"), ("f", "invalid_proxy")])
    bad = RelaySettings(user_agent="a\r\nb", dedup=DedupPolicy(default_window_s=10, max_window_s=5))
    empty = spark.createDataFrame([], "id string, proxy string")
    rules = sorted(r["rule"] for r in cg.validate_sources(empty, bad).collect())
    assert rules == ["dedup_max_window", "no_sources", "user_agent_newline"]


SRC = "id string, url string, headers map<string,string>, disabled boolean, proxy string, mapping string"


def test_diff_classes(spark):
    old = spark.createDataFrame([
        ("keep", "u", {"A": "1"}, False, None, "m"), ("gone", "u", None, False, None, None),
        ("stop", "u", None, False, None, None), ("url", "u", None, False, None, None),
        ("hdr", "u", {"A": "1"}, False, None, None), ("start", "u", None, True, None, None),
        ("map", "u", None, False, None, "m1"), ("offchg", "u", None, True, None, None),
    ], SRC)
    new = spark.createDataFrame([
        ("keep", "u", {"A": "1"}, False, None, "m"), ("stop", "u", None, True, None, None),
        ("url", "v", None, False, None, None), ("hdr", "u", {"A": "2"}, False, None, None),
        ("start", "u", None, False, None, None), ("map", "u", None, False, None, "m2"),
        ("offchg", "v", None, False, None, None), ("new", "u", None, False, None, None),
    ], SRC)
    got = {r["id"]: (r["change"], r["mapping_changed"]) for r in cg.diff_sources(old, new).collect()}
    assert got == {"keep": ("unchanged", False), "gone": ("removed", False), "stop": ("stopped", False),
                   "url": ("restarted", False), "hdr": ("restarted", False), "start": ("started", False),
                   "map": ("unchanged", True), "offchg": ("started", False), "new": ("added", False)}
    assert {r["change"] for r in cg.diff_sources(old, old).collect()} == {"unchanged"}
    assert {r["change"] for r in cg.diff_sources(old, old, tls_changed=True).filter(F.col("id") == "keep").collect()} == {"restarted"}


def test_list_sources_hides_secrets(spark):
    src = spark.createDataFrame([("b", "u2", {"A": "s"}, False, "http://p:1", None), ("a", "u1", None, False, None, "m")], SRC)
    states = spark.createDataFrame([("a", "connected")], "source string, state string")
    rows = cg.list_sources(src, states).collect()
    assert [tuple(r) for r in rows] == [("a", "u1", "m", "connected"), ("b", "u2", None, "disconnected")]
    assert rows[0].__fields__ == ["id", "url", "mapping", "state"]


def test_violations_keep_whole_ids(spark):
    rows = [("y" * 70_000 + "a", None), ("y" * 70_000 + "b", None), ("p", "\t"), ("q", "\u00a0 ")]
    out = cg.validate_sources(spark.createDataFrame(rows, "id string, proxy string")).collect()
    assert {r["id"] for r in out if r["rule"] == "id_too_long"} == {rows[0][0], rows[1][0]}
    assert {r["id"] for r in out if r["rule"] == "empty_proxy"} == {"p", "q"}
