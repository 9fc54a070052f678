"""Ordered scans, range sums and as-of joins against plain windows (random data)."""

import random

from pyspark.sql import Window, functions as F

from meshframes.operators import scan
from meshframes.operators.scan import asof, ordered_scan, range_sum


def _data(spark, n=600, keys=3, seed=7):
    rnd = random.Random(seed)
    rows = [(f"k{rnd.randrange(keys)}", rnd.randrange(0, 50_000), i, float(rnd.randrange(-5, 20))) for i in range(n)]
    return spark.createDataFrame(rows, "k string, ts long, id long, v double")


def test_ordered_scan_matches_windows(spark):
    df = _data(spark)
    for bucket in (1000, 7000, 100_000):
        out = ordered_scan(df, ["k"], "ts", ["id"], bucket_ms=bucket, lag=["v"], running_sum={"cs": F.col("v")},
                           running_max={"cm": F.col("v")}, row_number="rn", tail={"t3": (F.col("v"), 3)})
        w = Window.partitionBy("k").orderBy("ts", "id")
        cum = w.rowsBetween(Window.unboundedPreceding, 0)
        ref = df.select("*", F.lag("v").over(w).alias("prev_v"), F.sum("v").over(cum).alias("cs"),
                        F.max("v").over(cum).alias("cm"), (F.row_number().over(w) - 1).alias("rn"),
                        F.collect_list("v").over(w.rowsBetween(-2, 0)).alias("t3"))
        a = out.select(*ref.columns)
        assert a.exceptAll(ref).count() == 0 and ref.exceptAll(a).count() == 0, bucket


def test_range_sum_matches_range_window(spark):
    df = _data(spark)
    out = range_sum(df, ["k"], "ts", 2500, {"s": F.col("v")})
    ref = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("ts").rangeBetween(-2499, 0)))
    assert out.exceptAll(ref).count() == 0 and ref.exceptAll(out).count() == 0


def test_asof_matches_brute_force(spark):
    left = _data(spark, n=200, seed=1).select("k", "ts", "id")
    right = _data(spark, n=300, seed=2).select("k", "ts", F.col("id").alias("rid"), "v")
    out = {(r["k"], r["id"]): r["v"] for r in asof(left, right, ["k"], "ts", ["v"], right_tiebreak=["rid"]).collect()}
    rr = [tuple(r) for r in right.collect()]
    for k, ts, i in [tuple(r) for r in left.collect()]:
        cands = [(t, rid, v) for kk, t, rid, v in rr if kk == k and t <= ts]
        assert out[(k, i)] == (max(cands)[2] if cands else None)


def test_adaptive_buckets_match_windows(spark):
    df = _data(spark, n=800, keys=2, seed=11)
    # key k0 made dense: all its rows inside a narrow time range
    df = df.withColumn("ts", F.when(F.col("k") == "k0", F.col("ts") % 500).otherwise(F.col("ts")))
    out = ordered_scan(df, ["k"], "ts", ["id"], bucket_ms=100_000, rows_per_bucket=25, lag=["v"], row_number="rn",
                       running_sum={"cs": F.col("v")})
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = df.select("*", F.lag("v").over(w).alias("prev_v"), (F.row_number().over(w) - 1).alias("rn"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs"))
    a = out.select(*ref.columns)
    assert a.exceptAll(ref).count() == 0 and ref.exceptAll(a).count() == 0


def test_burst_after_quiet_months_is_cut_evenly(spark):
    """One source says nothing for months, then sends nearly all of its frames within a minute."""
    month = 30 * 86_400_000
    quiet = spark.range(60).select(F.lit("a").alias("k"), (F.col("id") * (month // 10)).alias("ts"))
    burst = spark.range(40_000).select(F.lit("a").alias("k"), (F.lit(6 * month) + F.col("id") * 60_000 / 40_000).cast("long").alias("ts"))
    other = spark.range(900).select(F.lit("b").alias("k"), (F.col("id") * 1000).alias("ts"))
    df = quiet.unionByName(burst).unionByName(other)
    cut = df.join(scan.quantile_bounds(df, ["k"], "ts", 1000), ["k"], "left").withColumn("bk", scan.bucket_of("ts", "_scan_bounds"))
    sizes = {(r.k, r.bk): r["count"] for r in cut.groupBy("k", "bk").count().collect()}
    mine = [n for (k, _), n in sizes.items() if k == "a"]
    assert 35 <= len(mine) <= 45 and max(mine) < 3 * sum(mine) / len(mine)
    assert sizes[("b", 0)] == 900  # a key that needs no cut is one bucket
    lows = [r.lo for r in cut.where("k = 'a'").groupBy("bk").agg(F.min("ts").alias("lo")).orderBy("bk").collect()]
    assert lows == sorted(lows)  # buckets follow time
    out = ordered_scan(df.withColumn("id", F.monotonically_increasing_id()), ["k"], "ts", ["id"], rows_per_bucket=1000, row_number="rn")
    assert out.groupBy("k").agg(F.count_distinct("rn").alias("n"), F.max("rn").alias("m")).orderBy("k").collect() == [("a", 40_060, 40_059), ("b", 900, 899)]
    late = out.where("k = 'a'").orderBy(F.col("rn").desc()).first()
    assert late.ts == df.where("k = 'a'").agg(F.max("ts")).first()[0]


def test_times_that_repeat_stay_in_one_bucket(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("ts"))
    cut = df.join(scan.quantile_bounds(df, ["k"], "ts", 100), ["k"], "left").withColumn("bk", scan.bucket_of("ts", "_scan_bounds"))
    assert cut.where("ts = 7").select("bk").distinct().count() == 1
    assert cut.groupBy("ts").agg(F.count_distinct("bk").alias("n")).where("n > 1").count() == 0


def test_null_keys_are_an_error(spark):
    import pytest

    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, t long")
    with pytest.raises(Exception, match="null in a key"):
        ordered_scan(df, ["k"], "t", row_number="n").collect()


def test_gaps_across_restarts(spark):
    from meshframes.operators.windows import runtime_gaps

    arrivals = {"a": [0, 1, 4, 5, 0, 2, 3, 1, 6], "b": [2, 3], "c": [5, 5], "d": [0]}
    rows = [(s, n, i // 3, i) for s, xs in arrivals.items() for i, n in enumerate(xs)]
    df = spark.createDataFrame(rows, "source string, sequence long, received_at_ms long, event_id long")
    got = sorted((tuple(r) for r in runtime_gaps(df, tiebreak=("event_id",)).collect()), key=str)
    want = [
        ("a", 0, 2, 2, 0), ("a", 0, 6, None, 1), ("a", 1, 1, 1, 1), ("a", 1, 4, None, 2), ("a", 2, 0, 1, 2), ("a", 2, 2, 4, 2),
        ("b", 0, 0, 2, 0), ("c", 0, 0, 5, 0), ("c", 0, 6, None, 0), ("c", 1, 0, 5, 0),
    ]
    assert got == sorted(want, key=str)


def test_range_sum_adds_no_range_anew(spark):
    # one dense bucket and its neighbours, repeated times, null values, bounds of buckets, negative times
    rows = [("a", t, v) for t, v in [(-1, 1.5), (0, 2.0), (0, None), (999, 0.25), (1000, 4.0), (1000, 8.0), (1998, 16.0), (1999, 32.0), (3500, None), (9000, 0.5)]]
    rows += [("b", 2000 + i % 700, 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, ts long, v double")
    out = range_sum(df, ["k"], "ts", 1000, {"s": F.col("v")})
    ref = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("ts").rangeBetween(-999, 0)))
    assert out.columns == ref.columns and out.exceptAll(ref).count() == 0 and ref.exceptAll(out).count() == 0
    # a sliding frame costs the square of its rows
    assert "RangeFrame, -999" not in out._jdf.queryExecution().executedPlan().toString()
    none = range_sum(spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0)], "k string, ts long, v double"), ["k"], "ts", 1000, {"s": F.col("v")})
    assert [r.s for r in none.collect()] == [3.0, 3.0]
