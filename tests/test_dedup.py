"""Dedup rules (FIXTURES 1.3) and D1 against a plain replay of the relay's rule."""

from pyspark.sql import functions as F

from meshframes import fixtures as fx
from meshframes.operators.dedup import dedup_aligned, dedup_first, dedup_replay, duplicate_report
from tests.conftest import SF_SMALL


def _frames(spark, rows):
    return spark.createDataFrame(
        [("s", i, ms, h) for i, (h, ms) in enumerate(rows)],
        "source string, sequence long, received_at_ms long, content_hash string",
    )


def _kept(df):
    return sorted(r["sequence"] for r in df.select("sequence").collect())


def test_first_admitted_duplicate_dropped(spark):
    f = _frames(spark, [("abc", 0), ("abc", 1), ("def", 2), ("def", 3)])
    assert _kept(dedup_replay(f, 60)) == [0, 2]
    assert _kept(dedup_aligned(f, 60)) == [0, 2]


def test_readmitted_after_two_windows(spark):
    # window 20 ms: abc@0 yes, abc@1 no, abc@26 no, abc@51 yes
    f = _frames(spark, [("abc", 0), ("abc", 1), ("abc", 26), ("abc", 51)])
    from meshframes.operators import dedup as d

    w_ms = 20
    # the operators take seconds; scale times by 1000 to keep the same ratios
    f_s = f.withColumn("received_at_ms", F.col("received_at_ms") * 1000)
    assert _kept(d.dedup_replay(f_s, w_ms, origin_ms=0)) == [0, 3]
    assert _kept(d.dedup_aligned(f_s, w_ms)) == [0, 3]


def test_silence_rotates_once_in_replay_only(spark):
    f = _frames(spark, [("abc", 0), ("abc", 86_400_000)])
    assert _kept(dedup_replay(f, 300, origin_ms=0)) == [0]
    assert _kept(dedup_aligned(f, 300)) == [0, 1]


def test_null_hash_always_passes(spark):
    f = _frames(spark, [(None, 0), ("a", 1), (None, 2), ("a", 3)])
    assert _kept(dedup_replay(f, 60)) == [0, 1, 2]
    assert _kept(dedup_aligned(f, 60)) == [0, 1, 2]
    assert _kept(dedup_first(f)) == [0, 1, 2]


def _replay(rows, w_ms, origin):
    rot, cur, prev, kept = origin, set(), set(), []
    for src, seq, ms, h in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if ms < origin:
            continue
        if h is None:
            kept.append((src, seq))
            continue
        if ms - rot >= w_ms:
            prev, cur, rot = cur, set(), ms
        if h in cur or h in prev:
            continue
        cur.add(h)
        kept.append((src, seq))
    return sorted(kept)


def test_replay_equals_plain_replay_on_events(spark):
    f = fx.frames_from_events(spark, SF_SMALL).select("source", "sequence", "received_at_ms", "content_hash")
    rows = [tuple(r) for r in f.collect()]
    origin = min(r[2] for r in rows)
    for window_s in (600, 3600, 6 * 3600):
        got = sorted((r["source"], r["sequence"]) for r in dedup_replay(f, window_s).collect())
        assert got == _replay(rows, window_s * 1000, origin), window_s


def test_dedup_outputs_are_subsets(spark):
    f = fx.frames_from_events(spark, SF_SMALL)
    n = f.count()
    for out in (dedup_aligned(f, 3600), dedup_replay(f, 3600), dedup_first(f)):
        assert out.count() <= n
        assert out.join(f, ["source", "sequence"], "left_anti").count() == 0


def test_duplicate_report_counts(spark):
    f = _frames(spark, [("a", 5), ("a", 9), ("b", 1), (None, 3)])
    r = {x["content_hash"]: (x["copies"], x["first_seen_ms"], x["last_seen_ms"]) for x in duplicate_report(f).collect()}
    assert r == {"a": (2, 5, 9), "b": (1, 1, 1)}


def test_bursts_of_a_hash(spark, monkeypatch):
    import random

    from meshframes.operators import dedup, scan

    r = random.Random(2)
    rows = [(f"s{r.randrange(4)}", r.choice([0, 5_000, 400_000, 900_000]) + r.randrange(3_000), r.choice(["h"] * 8 + ["g", None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "source string, received_at_ms long, content_hash string")
    want = []
    for h in ("g", "h"):
        seen = sorted((ms, s) for s, ms, x in rows if x == h)
        bursts = [[seen[0]]]
        for a, b in zip(seen, seen[1:]):
            bursts.append([b]) if b[0] - a[0] >= 2_000 else bursts[-1].append(b)
        want += [(h, i, len(b), len({s for _, s in b}), b[0][0], b[-1][0]) for i, b in enumerate(bursts)]
    got = lambda: sorted(tuple(x) for x in dedup.duplicate_report(df, 2).collect())
    assert got() == want and len(want) > 4
    monkeypatch.setattr(dedup, "ROWS_PER_BUCKET", 40)  # a hot hash in several buckets
    assert got() == want
    assert dedup.duplicate_report(df.limit(0), 2).count() == 0
