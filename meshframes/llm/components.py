"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step links nodes to the smallest node of their neighbourhood, so no node gathers a list; rounds
grow with the logarithm of the longest path. Each round is a stored table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshframes.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(a, b): every node linked to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lows = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    joined = both.join(lows, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(lows.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b): each node ``a`` that is not the smallest of its component, with that smallest node ``b``.

    edges: (a, b) in any direction; loops, repeats and nulls are ignored."""
    now = stored(edges.where("a <> b").select("a", "b").distinct(), name)
    before = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sums == before:
            return now
        before = sums
        now = stored(_star(_star(now, True), False), name)
