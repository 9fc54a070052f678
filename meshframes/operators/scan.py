"""Ordered scans per key that do not put a whole key into one task.

``lag``, running sums / maxima and 0-based row numbers ordered by time within a key
are usually written as a window partitioned by the key. A key holding a third of the
rows would then be one task. Here the window is partitioned by (key, time bucket);
each bucket's carry (its last row, its total, its count) is computed by a partial
aggregation, prefixed over the small per-bucket table, and joined back. The big
table is shuffled once, on (key, bucket), which the join and the in-bucket window
share; the summary side ships only partial aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

# One hour of epoch milliseconds: each (key, hour) is a unit of work.
DEFAULT_BUCKET_MS = 3_600_000
# Buckets by quantiles: about so many rows each, at most so many a key, from sketches whose ranks err by less than half a bucket then.
ROWS_PER_BUCKET = 2_000_000
MOST_BUCKETS = 1_024
SKETCH_K = 8_192


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tiebreak: Sequence[str] = (),
    *,
    bucket_ms: int = DEFAULT_BUCKET_MS,
    lag: Sequence[str] = (),
    lag_prefix: str = "prev_",
    running_sum: Mapping[str, Column] | None = None,
    running_max: Mapping[str, Column] | None = None,
    max_before: Mapping[str, Column] | None = None,
    row_number: str | None = None,
    tail: Mapping[str, tuple[Column, int]] | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Add per-key ordered-scan columns.

    * ``lag``: ``<lag_prefix><c>`` = value of ``c`` on the previous row of the key.
    * ``running_sum[out] = expr``: sum of ``expr`` over the key's rows up to this one.
    * ``running_max[out] = expr``: max of ``expr`` over the key's rows up to this one.
    * ``max_before[out] = expr``: the same over the rows before this one.
    * ``row_number``: 0-based position of the row within its key.
    * ``tail[out] = (expr, k)``: array of ``expr`` over the last ``k`` rows up to this
      one, oldest first (like ``collect_list`` over ``rowsBetween(-k+1, 0)``).

    Order is ``ts`` then ``tiebreak``; it should be total for deterministic output.
    A null key is an error (it would not meet its carry).

    ``rows_per_bucket``: instead of one fixed width, a key of more rows is cut at
    quantiles of its own times (:func:`quantile_bounds`), so a burst after a quiet
    time is cut as finely as any other rows; ``bucket_ms`` is not used then.
    """
    running_sum = dict(running_sum or {})
    running_max = dict(running_max or {})
    max_before = dict(max_before or {})
    tail = dict(tail or {})
    order = [ts, *tiebreak]
    bk = "_scan_bk"
    part = [*keys, bk]
    # The per-bucket summary is a partial (map-side) aggregation: it ships one row
    # per (key, bucket, map task). The input itself is shuffled once, on
    # (key, bucket), for the join of the carry and the in-bucket window.
    if rows_per_bucket:
        # a row for each key that is cut: AQE broadcasts it when its measured size allows, else splits a hot key's rows
        d = df.join(quantile_bounds(df, keys, ts, rows_per_bucket), list(keys), "left")
        d = d.withColumn(bk, bucket_of(ts, "_scan_bounds")).drop("_scan_bounds")
    else:
        d = df.withColumn(bk, F.floor(F.col(ts) / F.lit(bucket_ms)).cast("long"))
    nullable = [F.col(k).isNull() for k in keys if d.schema[k].nullable]
    if nullable:
        d = d.withColumn(bk, F.when(reduce(or_, nullable), F.raise_error(f"ordered_scan: null in a key of {list(keys)}").cast("long")).otherwise(F.col(bk)))

    aggs = []
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in lag]), F.struct(*order)).alias("_scan_last"))
    for out, e in running_sum.items():
        aggs.append(F.sum(e).alias(f"_scan_s_{out}"))
    for out, e in {**running_max, **max_before}.items():
        aggs.append(F.max(e).alias(f"_scan_m_{out}"))
    if row_number:
        aggs.append(F.count(F.lit(1)).alias("_scan_n"))
    w_in = Window.partitionBy(*part).orderBy(*order)
    w_cum = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = d.groupBy(*part).agg(*aggs) if aggs else None

    if tail:
        # last k rows of every bucket (bounded by k), then the k rows before each bucket
        w_desc = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
        tails = None
        for out, (e, k) in tail.items():
            t = (
                d.select(*part, *order, e.alias("_v"))
                .withColumn("_r", F.row_number().over(w_desc))
                .filter(F.col("_r") <= k)
                .groupBy(*part)
                .agg(F.sort_array(F.collect_list(F.struct(*order, F.col("_v")))).alias(f"_scan_t_{out}"))
            )
            tails = t if tails is None else tails.join(t, part, "full")
        summary = tails if summary is None else summary.join(tails, part, "full")

    w_keys = Window.partitionBy(*keys).orderBy(bk)
    prev = w_keys.rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.col(c) for c in part]
    if lag:
        cols.append(F.lag("_scan_last").over(w_keys).alias("_scan_plast"))
    for out in running_sum:
        cols.append(F.sum(f"_scan_s_{out}").over(prev).alias(f"_scan_ps_{out}"))
    for out in [*running_max, *max_before]:
        cols.append(F.max(f"_scan_m_{out}").over(prev).alias(f"_scan_pm_{out}"))
    if row_number:
        cols.append(F.coalesce(F.sum("_scan_n").over(prev), F.lit(0)).alias("_scan_pn"))
    for out, (_, k) in tail.items():
        # k previous non-empty buckets always hold at least k rows
        back = w_keys.rowsBetween(-k, -1)
        carried = F.flatten(F.collect_list(f"_scan_t_{out}").over(back))
        start = F.greatest(F.size(carried) - F.lit(k) + 1, F.lit(1))
        cols.append(F.slice(carried, start, F.lit(k)).alias(f"_scan_pt_{out}"))
    carry = summary.select(*cols)
    j = d.join(carry, part, "left")

    rn = F.row_number().over(w_in)
    out_cols = []
    for c in lag:
        out_cols.append(
            F.when(rn == 1, F.col("_scan_plast")[c]).otherwise(F.lag(c).over(w_in)).alias(f"{lag_prefix}{c}")
        )
    for out, e in running_sum.items():
        here = F.sum(e).over(w_cum)
        before = F.col(f"_scan_ps_{out}")
        out_cols.append(
            F.when(here.isNull(), before).when(before.isNull(), here).otherwise(before + here).alias(out)
        )
    for out, e in running_max.items():
        out_cols.append(F.greatest(F.col(f"_scan_pm_{out}"), F.max(e).over(w_cum)).alias(out))
    for out, e in max_before.items():
        out_cols.append(F.greatest(F.col(f"_scan_pm_{out}"), F.max(e).over(w_in.rowsBetween(Window.unboundedPreceding, -1))).alias(out))
    if row_number:
        out_cols.append((F.col("_scan_pn") + rn - 1).cast("long").alias(row_number))
    for out, (e, k) in tail.items():
        here = F.collect_list(e).over(w_in.rowsBetween(-(k - 1), Window.currentRow))
        need = F.lit(k) - F.size(here)
        pt = F.col(f"_scan_pt_{out}")
        before = F.transform(pt, lambda s: s["_v"])
        take = F.slice(before, F.greatest(F.size(before) - need + 1, F.lit(1)), need)
        out_cols.append(F.when(pt.isNull() | (need <= 0), here).otherwise(F.concat(take, here)).alias(out))
    base = [F.col(c) for c in df.columns]
    return j.select(*base, *out_cols)


def run_starts(df: DataFrame, keys: Sequence[str], at: str, out: str, bucket: int = 4_096) -> DataFrame:
    """Add the first value of the run of consecutive integers ``at`` (distinct per key) that a row belongs to.

    A scan whose carry is the run in progress: each bucket of ``bucket`` integers finds the runs that begin in it, and tells the next ones its last run's
    start; only whether its first run goes on from the bucket before is settled among the buckets' summaries. So a run of any length is no group
    of its own."""
    part = [*keys, "_run_bk"]
    w = Window.partitionBy(*part).orderBy(at)
    gap = F.col(at) - F.lag(at).over(w)
    d = df.withColumn("_run_bk", F.floor(F.col(at) / bucket).cast("long")).withColumn("_begins", F.when(gap > 1, F.col(at)))
    ends = d.groupBy(*part).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.max("_begins").alias("_in"))
    order = Window.partitionBy(*keys).orderBy("_run_bk")
    before = F.lag("_hi").over(order)
    ends = ends.withColumn("_first", F.when(before.isNull() | (F.col("_lo") - before > 1), F.col("_lo")))
    going_on = F.max(F.coalesce("_in", "_first")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(*part, F.coalesce("_first", going_on).alias("_first"))
    begun = F.max("_begins").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.join(carry, part, "left").select(*df.columns, F.coalesce(begun, F.col("_first")).alias(out))


def quantile_bounds(df: DataFrame, keys: Sequence[str], ts: str, rows_per_bucket: int) -> DataFrame:
    """(keys, ``_scan_bounds``): ascending first values of ``ts`` of a key's buckets but the first, for keys of more than ``rows_per_bucket`` rows.

    The bounds are quantiles of a KLL sketch of the key's own times, so buckets hold about ``rows_per_bucket`` rows wherever
    its rows lie: months of silence before a burst cost no bucket. Only the keys that need cutting are sketched (at most rows / ``rows_per_bucket``
    of them); a key is cut into :data:`MOST_BUCKETS` at most, so buckets of a key beyond that many times ``rows_per_bucket`` grow with it.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_bucket)
    sketched = df.select(*keys, F.col(ts).cast("long").alias("_t")).join(counts, list(keys)).groupBy(*keys, "_n")
    grid = F.array(*[F.lit(i / MOST_BUCKETS) for i in range(1, MOST_BUCKETS)])
    cut = sketched.agg(F.kll_sketch_agg_bigint("_t", F.lit(SKETCH_K)).alias("_sketch")).select(
        *keys, F.least(F.ceil(F.col("_n") / rows_per_bucket), F.lit(MOST_BUCKETS)).alias("_m"), F.kll_sketch_get_quantile_bigint("_sketch", grid).alias("_q"))
    places = F.transform(F.sequence(F.lit(1), F.col("_m").cast("int") - 1), lambda i: F.round(i * MOST_BUCKETS / F.col("_m")).cast("int") - 1)
    return cut.select(*keys, F.array_distinct(F.transform(places, lambda i: F.get("_q", i))).alias("_scan_bounds"))


def bucket_of(ts: str, bounds: str) -> Column:
    """Number of bounds at or below ``ts``, by binary search in the sorted array (0 where it is null)."""
    steps = F.array(*[F.lit(1 << i) for i in range(MOST_BUCKETS.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col(ts), at + step).otherwise(at))
    return F.when(F.col(bounds).isNull(), F.lit(0)).otherwise(found).cast("long")


def range_sum(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    width: int,
    sums: Mapping[str, Column],
) -> DataFrame:
    """Per key, ``sum(expr)`` over rows with ``ts`` in ``(t - width, t]``.

    Same result as ``rangeBetween(-(width - 1), 0)`` over ``partitionBy(keys)``,
    but partitioned by (key, ts-bucket of size ``width``): every row is also copied
    into the next bucket, so each bucket sees the whole range of its own rows. Data
    is doubled once; no key is ever a single task.

    A row's range is the start of its own bucket up to it and the end of the bucket before. Both are running sums (Spark adds up a
    sliding range anew for every row, so a dense bucket would cost its square); nothing is subtracted, so sums of doubles lose no digits.
    """
    b = F.floor(F.col(ts) / F.lit(width)).cast("long")
    vals = {f"_rs_v_{o}": e for o, e in sums.items()}
    d = df.select("*", *[e.alias(n) for n, e in vals.items()]).withColumn("_rs_b", b)
    d = d.withColumn("_rs_shift", F.explode(F.array(F.lit(0), F.lit(1))))
    d = d.withColumn("_rs_b", F.col("_rs_b") + F.col("_rs_shift"))
    copied = F.col("_rs_shift") == 1
    # own rows in order, the copies of the bucket before backwards: sums from its end
    run = Window.partitionBy(*keys, "_rs_b", "_rs_shift").orderBy(F.when(copied, -F.col(ts)).otherwise(F.col(ts))).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select("*", *[F.sum(f"_rs_v_{o}").over(run).alias(f"_rs_s_{o}") for o in sums])
    # of the copies that are in a row's range the earliest holds the sum of all
    back = Window.partitionBy(*keys, "_rs_b").orderBy(F.when(copied, F.col(ts) + (width - 1)).otherwise(F.col(ts)).desc(), F.col("_rs_shift").desc())
    back = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = [F.col(c) for c in df.columns]
    out = d.select(*base, "_rs_shift", *[F.col(f"_rs_s_{o}") for o in sums], *[
        F.last(F.when(copied & F.col(ts).isNotNull(), F.col(f"_rs_s_{o}")), ignorenulls=True).over(back).alias(f"_rs_p_{o}") for o in sums])
    total = [F.coalesce(F.col(f"_rs_p_{o}") + F.col(f"_rs_s_{o}"), F.col(f"_rs_p_{o}"), F.col(f"_rs_s_{o}")).alias(o) for o in sums]
    return out.filter(F.col("_rs_shift") == 0).select(*base, *total)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    right_tiebreak: Sequence[str] = (),
    prefix: str = "",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """As-of join: for every ``left`` row, the ``values`` of the latest ``right`` row
    of the same key with ``right.ts <= left.ts`` (null when there is none)."""
    return asof_many(left, keys, ts, [(right, list(values), list(right_tiebreak), prefix)], rows_per_bucket)


def asof_many(left: DataFrame, keys: Sequence[str], ts: str, rights, rows_per_bucket: int | None = None) -> DataFrame:
    """Several as-of joins in one pass: ``rights`` is a list of
    ``(right, values, right_tiebreak, prefix)``.

    All sides are unioned and a bucketed running maximum of (ts, tiebreak, values)
    per right side carries its latest row forward to the left rows; no range join,
    no key in one task, one shuffle for all sides.
    """
    lcols = left.columns
    parts, carries = [], []
    for i, (right, values, tb, _) in enumerate(rights):
        carry = F.struct(F.col(ts).alias("_t"), *[F.col(c).alias(f"_tb{j}") for j, c in enumerate(tb)],
                         *[F.col(v).alias(v) for v in values])
        parts.append(right.select(*keys, ts, carry.alias(f"_asof_v{i}"), F.lit(0).alias("_asof_side")))
        carries.append(parts[-1].schema[f"_asof_v{i}"].dataType)
    u = left.select("*", F.lit(1).alias("_asof_side"), F.monotonically_increasing_id().alias("_asof_id"),
                    *[F.lit(None).cast(t).alias(f"_asof_v{i}") for i, t in enumerate(carries)])
    for p in parts:
        u = u.unionByName(p, allowMissingColumns=True)
    s = ordered_scan(u, list(keys), ts, ["_asof_side", "_asof_id"],
                     running_max={f"_asof_c{i}": F.col(f"_asof_v{i}") for i in range(len(rights))},
                     rows_per_bucket=rows_per_bucket)
    s = s.filter(F.col("_asof_side") == 1)
    out = [F.col(c) for c in lcols]
    for i, (_, values, _, prefix) in enumerate(rights):
        out += [F.col(f"_asof_c{i}")[v].alias(f"{prefix}{v}") for v in values]
    return s.select(*out)
