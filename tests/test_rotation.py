"""Rotation tiles and run starts against plain loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from meshframes.operators import rotation as rot
from meshframes.operators.dedup import dedup_aligned, dedup_replay
from meshframes.operators.scan import run_starts


def _gens(times, w):
    """Rotations up to each arrival, one after the other (the start, 0, is the first rotation)."""
    last, n, out = 0, 0, {}
    for t in sorted(times):
        if t - last >= w:
            last, n = t, n + 1
        out[t] = n
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, unique=True), st.integers(1, 25), st.integers(2, 4))
def test_tile_functions_and_their_composition(times, w, span):
    size = w * span
    tiles = {}
    for t in sorted(times):
        tiles.setdefault(t // size, []).append(t)
    functions = [(k * size, *rot.tile_function(np.array(x), k * size, size, w)) for k, x in sorted(tiles.items())]
    for (start, hi, out, cnt), x in zip(functions, [x for _, x in sorted(tiles.items())]):
        assert (np.diff(hi) > 0).all() and hi[-1] == start + w
        for v in range(start, start + w + 1):
            at, n = v, 0
            for t in x:
                if t >= at:
                    at, n = t + w, n + 1
            j = int(np.searchsorted(hi, v))
            assert (out[j], cnt[j]) == (max(at, start + size), n)
    big = size * 3
    groups = {}
    for f in functions:
        groups.setdefault(f[0] // big, []).append(f)
    for g, children in groups.items():
        hi, out, cnt = rot.composed(children, g * big, (g + 1) * big, w)
        for v in range(g * big, g * big + w + 1):
            at, n = v, 0
            for t in sorted(t for t in times if t // big == g):
                if t >= at:
                    at, n = t + w, n + 1
            j = int(np.searchsorted(hi, v))
            assert (out[j], cnt[j]) == (max(at, (g + 1) * big), n)


@pytest.mark.parametrize("span,n,most", [(2, 300, 40_000), (3, 500, 9_000), (32, 400, 3_000_000), (2, 30, 50)])
def test_generations_against_a_loop(spark, monkeypatch, span, n, most):
    monkeypatch.setattr(rot, "MOST_SPAN", span)
    r = random.Random(span + n)
    rows = {(s, 100 + o + r.randrange(most), 100 + o) for s, o in (("a", 0), ("b", 7), ("c", 50)) for _ in range(n if s != "c" else 3)} | {("a", 99, 100)}
    df = spark.createDataFrame(sorted(rows), "sub string, received_at_ms long, _origin long")
    got = {(x["sub"], x.received_at_ms): x._gen for x in rot.rotation_generations(df, ["sub"], 20).collect()}
    want = {}
    for s in "abc":
        origin = next(o for k, _, o in rows if k == s)
        want |= {(s, t + origin): g for t, g in _gens([t - origin for k, t, _ in rows if k == s and t >= origin], 20).items()}
    assert got == want
    one = df.where("sub = 'a'").drop("sub")
    assert {x.received_at_ms: x._gen for x in rot.rotation_generations(one, [], 20).collect()} == {t: g for (s, t), g in want.items() if s == "a"}


def test_class_rows_fall_from_level_to_level(spark):
    """A tile keeps no more classes than distinct results: dense arrivals meet after a few windows."""
    x = np.arange(0, 32 * 1000)
    assert len(rot.tile_function(x, 0, 32 * 1000, 1000)[0]) == 1001  # arrivals in each millisecond: no two chains meet
    sparse = np.unique(np.random.default_rng(1).integers(0, 32_000, 800))
    hi, out, cnt = rot.tile_function(sparse, 0, 32_000, 1000)
    assert len(hi) < (sparse <= 1000).sum() / 1.5


def test_run_starts_over_many_buckets(spark):
    r = random.Random(3)
    rows = [("hot", i) for i in range(500)] + [(k, i) for k in "ab" for i in sorted(r.sample(range(-40, 200), 90))]
    got = run_starts(spark.createDataFrame(rows, "k string, g long"), ["k"], "g", "s", bucket=7).collect()
    have = set(rows)
    for x in got:
        s = x.g
        while (x.k, s - 1) in have:
            s -= 1
        assert x.s == s
    assert len(got) == len(rows)


def _frames(spark, n, hashes):
    return spark.range(n).select(
        F.lit("s").alias("source"), F.col("id").alias("sequence"), (F.col("id") * 250).alias("received_at_ms"), hashes(F.col("id")).alias("content_hash"))


def test_a_hash_in_every_generation_is_no_single_task(spark):
    """One hash in each of 10,000 windows: the run is dealt over buckets, and every second window keeps its first frame."""
    df = _frames(spark, 40_000, lambda i: F.when(i % 10 == 0, F.concat(F.lit("rare"), i.cast("string"))).otherwise(F.lit("hot")))
    firsts = df.where("content_hash = 'hot'").select("content_hash", F.floor(F.col("received_at_ms") / 1000).cast("long").alias("_gen")).distinct()
    buckets = firsts.groupBy("content_hash", F.floor(F.col("_gen") / 4096)).count()
    assert buckets.count() >= 3 and buckets.agg(F.max("count")).first()[0] <= 4096
    kept = dedup_aligned(df, 1).where("content_hash = 'hot'")
    assert kept.count() == 5000 and kept.where((F.col("received_at_ms") / 1000).cast("long") % 2 != 0).count() == 0
    assert dedup_replay(df, 1).where("content_hash = 'hot'").count() == 5000


def test_a_frame_captured_twice_is_one_frame(spark):
    df = _frames(spark, 40, lambda i: (i % 3).cast("string"))
    twice = df.unionByName(df)
    for fn in (dedup_aligned, dedup_replay):
        a, b = fn(df, 2), fn(twice, 2)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_dedup_per_subscription(spark):
    r = random.Random(9)
    rows = [(s, "x", i, r.randrange(60_000), f"h{r.randrange(6)}") for s in ("one", "two") for i in range(200)]
    df = spark.createDataFrame(rows, "sub string, source string, sequence long, received_at_ms long, content_hash string")
    for fn in (dedup_aligned, dedup_replay):
        both = sorted(map(tuple, fn(df, 3, sub="sub").collect()))
        apart = [tuple(x) for s in ("one", "two") for x in fn(df.where(F.col("sub") == s), 3).collect()]
        assert both == sorted(apart)
