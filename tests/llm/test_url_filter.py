from meshframes.llm import url_filter as uf
from pyspark.sql import functions as F


LISTED = ("adult-x.example.com", "ads-track.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")


def plain(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = []
    for verdict, rule in uf.RULES:
        h, _, p = rule.partition("/")
        if ("." + host).endswith("." + h) and path.startswith("/" + p):
            fit.append((-len(rule), rule, verdict))
    parts = host.split(".")
    bad = any(".".join(parts[i:]) in listed for i in range(len(parts)))
    return host, path, min(fit)[1] if fit else None, min(fit)[2] if fit else ("block" if bad else "allow")


URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.NET/en/1?x=/y#z", "http://a.example.net", "http://a.example.net/", "ftp://x.org/fr/2", "http://org/fr/", "http://xorg/fr/",
    "http://example.com/de/x", "http://example.com/den", "http://example.com/de", "http://m.ads-track.example.com/en/1", "http://ads-track.example.com?q=http://b.net/",
    "http://bads-track.example.com/", "http://h#frag/x", "http://a\nb.com/c\nd?e", "http://ÄB.com/Ä", "x://y://z/", "http://spam-farm.example.org/fr/1", "http://spam-farm.example.org/en/1",
    "http://.../", "http://net/x", "http://u:p@adult-x.example.com:80/",
]


def test_verdicts_match_plain_version(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)] + [(None, URLS[4])], "page_id long, url string").selectExpr("*", "'own' as host", "'own' as key", "1 as p", "true as inside")
    listed = spark.createDataFrame([(k,) for k in LISTED] + [("elsewhere.test",), (None,), (LISTED[0],)], "key string")
    out = uf.judge(pages, listed)
    assert out.columns == ["page_id", "url", "key", "p", "inside", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == 2 * len(URLS) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, LISTED), r.url


def test_cascade_is_exact_for_the_whole_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("h"), "id", F.lit(".test")).alias("key"))
    listed = universe.where(F.xxhash64("key") % 7 == 0)
    levels = uf.build(universe, listed)
    assert len(levels) > 2
    got = universe.withColumn("in", uf.is_listed(F.col("key"), levels))
    assert got.where(F.col("in") != (F.xxhash64("key") % 7 == 0)).count() == 0
    bits = sum(x.bits for x in levels)
    assert bits < 20 * listed.count()
    assert "Join" not in got._jdf.queryExecution().toString()


def test_empty_inputs(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    listed = spark.createDataFrame([("a.b",)], "key string")
    assert uf.judge(pages, listed).count() == 0
    some = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    assert uf.judge(some, listed.limit(0)).first().verdict == "allow"
    assert uf.judge(some, listed).first().verdict == "block"


def test_too_long_a_list_is_an_error(spark):
    import pytest

    universe = spark.createDataFrame([("a",), ("b",)], "key string")
    with pytest.raises(ValueError):
        uf.build(universe, universe, max_keys=1)


def test_a_list_beyond_the_bound_is_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").selectExpr("*", "'own' as host", "'own' as key")
    listed = spark.createDataFrame([(k,) for k in LISTED] + [(None,), (LISTED[0],)], "key string")
    want = sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in uf.judge(pages, listed).collect())
    assert sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in uf.judge(pages, listed, max_keys=0).collect()) == want
    monkeypatch.setattr(uf, "MOST_LABELS", 2)
    assert sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in uf.judge(pages, listed).collect()) == want


def test_names_are_listed_under_any_suffix(spark):
    hosts = spark.createDataFrame([(h,) for h in ("m.ads-track.example.com", "ads-track.org", "ads-track", "xads-track.org", "a.b", "", None)], "host string")
    got = sorted(r.key for r in uf.named_keys(uf.universe_of(hosts), uf.NAMES).collect())
    assert got == ["ads-track", "ads-track.example.com", "ads-track.org"]


def test_plans_do_not_hold_the_filter(spark):
    universe = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".test")).alias("key"))
    pages = universe.select(F.monotonically_increasing_id().alias("page_id"), F.concat(F.lit("http://"), "key").alias("url"))
    few, many = (uf.judge(pages, universe.where(F.xxhash64("key") % n == 0)) for n in (100, 2))
    plan = many._jdf.queryExecution().toString()
    assert "Python" not in plan and "Join" not in plan
    assert len(plan) < 3 * len(few._jdf.queryExecution().toString())
    assert many.where("verdict = 'block'").count() == universe.where(F.xxhash64("key") % 2 == 0).count()
