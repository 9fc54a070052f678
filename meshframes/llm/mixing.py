"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents, in the order of a hash, form a stream that is cut into blocks of ``block_chars``
characters (a document belongs to the block in which it begins). Weights become whole shares of a period of
about ``slots`` slots, at least one each. Block i (from 0) of a source with share c in a period of p slots is released at slot
``floor(i * p / c)`` and due before slot ``ceil((i + 1) * p / c)``. Earliest-deadline-first fills every
slot in time, so after any number of slots each source is within one block of its whole share. Releases and
deadlines repeat with the period, so the schedule of one period (a fold over its slots, whose cost
depends on ``slots`` and the number of sources only) gives the slot of every block of any corpus:
``floor(block / c) * p + slot_of[block % c]``.

A source may hold any part of all rows: its stream is cut at hash prefixes into buckets of about
``BUCKET_ROWS`` rows; sums by bucket give each bucket's place in the stream and only a bucket is ever sorted.
The plan has a row for each source and an integer for each slot of the period; it is written to a table first, so Spark broadcasts it if its
size allows and shuffles by source otherwise.

Nothing is dropped: every row is returned, with its slot. Slots of a source that has run out stay empty.
``mixed`` tells which rows make the mixture at the whole shares: it ends when the last source whose share is not below its part of
all characters has run out; blocks beyond it are surplus. Shares are rounded, so that may also be a few last blocks of
a source that is not capped, and "within one block" holds for the rounded shares only.

Defined results: a null source is a source of its own; a null text has no characters and lies where it falls; a source without
a positive weight has null block and slot and is not mixed; equal rows are interchangeable; an empty
table gives no rows; columns of the new names are replaced, others pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshframes.llm.common import stored

BUCKET_ROWS = 5_000
ADDED = ["block", "slot", "mixed"]


def _size() -> Column:
    return F.coalesce(F.length("text"), F.lit(0)).cast("long")


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, docs, chars): a row for each source."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(_size()).alias("chars"))


def capped_weights(sizes: DataFrame, max_share: float = 0.2) -> DataFrame:
    """(source, weight): sizes in characters, but no source above ``max_share`` of the mixture.

    If the capped sources alone would make the whole, every source keeps its size."""
    all_ = Window.partitionBy()
    over = F.col("chars") > max_share * F.sum("chars").over(all_)
    rest = F.sum(F.when(~over, F.col("chars")).otherwise(0)).over(all_)
    room = 1.0 - max_share * F.sum(over.cast("int")).over(all_)
    cap = F.floor(max_share / room * rest)
    return sizes.select("source", F.when(over & (room > 0) & (rest > 0), cap).otherwise(F.col("chars")).cast("long").alias("weight"))


def period(weights: DataFrame, slots: int = 1000) -> DataFrame:
    """(source, share, period, slot_of): the earliest-deadline-first schedule of one period."""
    total = F.sum("weight").over(Window.partitionBy())
    shares = weights.where(F.col("weight") > 0).withColumn("share", F.greatest(F.lit(1), F.floor(F.col("weight") * F.lit(float(slots)) / total + 0.5)).cast("int"))
    one = shares.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("s"), F.sum("share").cast("int").alias("period"))

    def step(state: Column, t: Column) -> Column:
        def due(s: Column, i: Column) -> Column:
            done = F.get(state["done"], i).cast("long")
            p, c = F.col("period").cast("long"), s["share"]
            released = F.floor(done * p / c) <= t
            deadline = F.floor(((done + 1) * p + c - 1) / c)
            return F.when(released, F.struct(deadline.alias("deadline"), i.alias("i")))

        pick = F.array_min(F.transform("s", due))["i"]
        # done: blocks of each source so far; picks: the source of each slot so far
        return F.transform(F.array(pick), lambda k: F.struct(
            F.transform(state["done"], lambda n, i: n + (i == k).cast("int")).alias("done"),
            F.concat(state["picks"], F.array(k)).alias("picks"),
        ))[0]

    start = F.struct(F.transform("s", lambda s: F.lit(0)).alias("done"), F.expr("cast(array() as array<int>)").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0), F.col("period") - 1), start, step, lambda x: x["picks"])
    each = one.where(F.size("s") > 0).select("s", "period", picks.alias("picks")).select(F.posexplode("s").alias("i", "x"), "period", "picks")
    slot_of = F.filter(F.transform("picks", lambda k, t: F.when(k == F.col("i"), t)), lambda t: t.isNotNull())
    return each.select(F.col("x.source").alias("source"), F.col("x.share").alias("share"), "period", slot_of.alias("slot_of"))


def _slot(block: Column) -> Column:
    share = F.col("share").cast("long")
    return F.floor(block / share) * F.col("period") + F.get("slot_of", (block % share).cast("int"))


def mix(docs: DataFrame, weights: DataFrame, sizes: DataFrame | None = None, slots: int = 1000, block_chars: int = 65_536) -> DataFrame:
    """``docs`` (doc_id, text, source and others) with ``block``, ``slot`` and ``mixed``; weights: (source, weight)."""
    sizes = source_sizes(docs) if sizes is None else sizes
    plan = sizes.alias("z").join(period(weights, slots).alias("w"), F.col("z.source").eqNullSafe(F.col("w.source")), "left")
    plan = plan.select(F.col("z.source").alias("source"), "docs", "chars", "share", "period", "slot_of")
    last = _slot(F.greatest(F.lit(1), F.ceil(F.col("chars") / F.lit(block_chars))) - 1)
    short = F.col("share").cast("double") / F.col("period") >= F.col("chars") / F.sum(F.when(F.col("share").isNotNull(), F.col("chars"))).over(Window.partitionBy())
    plan = plan.withColumn("end", F.max(F.when(short, last)).over(Window.partitionBy()) + 1)
    plan = plan.select(
        F.col("source").alias("__llm_s"), F.struct("share", "period", "slot_of", "end").alias("__llm_plan"),
        F.ceil(F.col("docs") / F.lit(BUCKET_ROWS)).cast("long").alias("__llm_buckets"),
    )
    rows = docs.select([c for c in docs.columns if c not in ADDED]).withColumn("__llm_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = rows.join(stored(plan, "mixing-plan"), F.col("source").eqNullSafe(F.col("__llm_s")), "left").drop("__llm_s")
    prefix = F.conv(F.substring("__llm_h", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__llm_n", _size()).withColumn("__llm_b", F.floor(prefix * F.col("__llm_buckets") / F.lit(float(1 << 32))).cast("long")).drop("__llm_buckets")
    sums = rows.groupBy("source", "__llm_b").agg(F.sum("__llm_n").alias("__llm_t"))
    before = Window.partitionBy("source").orderBy("__llm_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__llm_s"), F.col("__llm_b").alias("__llm_sb"), F.coalesce(F.sum("__llm_t").over(before), F.lit(0)).alias("__llm_from"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("__llm_s")) & (F.col("__llm_b") == F.col("__llm_sb"))).drop("__llm_s", "__llm_sb")
    inside = Window.partitionBy("source", "__llm_b").orderBy("__llm_h", "doc_id", "__llm_n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__llm_from") + F.coalesce(F.sum("__llm_n").over(inside), F.lit(0))
    rows = rows.withColumn("block", F.floor(start / F.lit(block_chars)).cast("long"))
    share = F.col("__llm_plan.share").cast("long")
    slot = F.floor(F.col("block") / share) * F.col("__llm_plan.period") + F.get(F.col("__llm_plan.slot_of"), (F.col("block") % share).cast("int"))
    rows = rows.withColumn("slot", slot.cast("long")).withColumn("mixed", F.coalesce(F.col("slot") < F.col("__llm_plan.end"), F.lit(False)))
    rows = rows.withColumn("block", F.when(share.isNotNull(), F.col("block")))
    return rows.select([c for c in docs.columns if c not in ADDED] + ADDED)


#: DuckDB SQL for :func:`mix` with :func:`capped_weights` over ``documents``, with the default parameters.
SQL = """
WITH RECURSIVE sizes AS (
    SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source),
marked AS (SELECT *, chars > 0.2 * sum(chars) OVER () AS hot FROM sizes),
weights AS (SELECT source, chars,
    CASE WHEN hot AND 1.0 - 0.2 * sum(hot::INT) OVER () > 0 AND sum(CASE WHEN hot THEN 0 ELSE chars END) OVER () > 0
         THEN floor(0.2::DOUBLE / (1.0::DOUBLE - 0.2::DOUBLE * sum(hot::INT) OVER ()) * sum(CASE WHEN hot THEN 0 ELSE chars END) OVER ()) ELSE chars END::BIGINT AS weight FROM marked),
shares AS (SELECT source, chars, greatest(1, floor(weight * 1000.0::DOUBLE / sum(weight) OVER () + 0.5))::BIGINT AS share FROM weights WHERE weight > 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, sum(share) OVER ()::BIGINT AS p FROM shares),
arr AS (SELECT list(share ORDER BY i) AS c, max(p) AS p FROM numbered),
edf AS (
    SELECT 0::BIGINT AS t, NULL::BIGINT AS pick, list_transform(c, lambda x: 0::BIGINT) AS done FROM arr
    UNION ALL
    SELECT t + 1, q, list_transform(done, lambda n, i: n + (i = q + 1)::BIGINT) FROM (
        SELECT t, done, list_min(list_transform(list_filter(range(len(c)), lambda i: done[i + 1] * p // c[i + 1] <= t),
            lambda i: (((done[i + 1] + 1) * p + c[i + 1] - 1) // c[i + 1]) * 1000000 + i)) % 1000000 AS q
        FROM edf, arr WHERE t < p)),
period AS (SELECT t - 1 AS slot, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM edf WHERE pick IS NOT NULL),
ends AS (SELECT max(CASE WHEN share::DOUBLE / p >= chars::DOUBLE / total
        THEN (b // share) * p + (SELECT slot FROM period WHERE period.i = x.i AND k = b % share) END) + 1 AS stop
    FROM (SELECT *, greatest(1, ceil(chars / 65536.0))::BIGINT - 1 AS b, sum(chars) OVER () AS total FROM numbered) x),
blocks AS (SELECT doc_id, source, coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, coalesce(length(text), 0)
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 65536 AS block FROM documents)
SELECT doc_id, b.source, CASE WHEN share IS NOT NULL THEN block END AS block,
    ((block // share) * p + slot)::BIGINT AS slot, coalesce((block // share) * p + slot < (SELECT stop FROM ends), false) AS mixed
FROM blocks b LEFT JOIN numbered n ON b.source IS NOT DISTINCT FROM n.source LEFT JOIN period ON period.i = n.i AND k = block % share
"""
