"""Totals and counts (A1-A8). All are partial + final hash aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshframes.operators.scan import ROWS_PER_BUCKET, ordered_scan


def source_totals(frames: DataFrame, by_hour: bool = False) -> DataFrame:
    """A1: packets, bytes and last packet time per source (optionally per hour)."""
    keys = [F.col("source")]
    if by_hour:
        keys.append((F.floor(F.col("received_at_ms") / 3600000) * 3600000).cast("long").alias("hour_ms"))
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("payload_bytes").alias("bytes"),
        F.max("received_at_ms").alias("last_packet_ms"),
    )


def relay_totals(frames: DataFrame) -> DataFrame:
    """A2: packets and bytes over all sources."""
    return frames.agg(F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).cast("long").alias("bytes"))


def snapshot_totals(source_rates: DataFrame) -> DataFrame:
    """A3: per tick, pps = sum of packet rates, kbit_s = sum of byte rates * 8 / 1000."""
    return source_rates.groupBy("at_ms").agg(
        F.sum("packets_per_s").alias("pps"),
        (F.sum("bytes_per_s") * 8 / 1000).alias("kbit_s"),
    )


def connected_counts(states: DataFrame, by=None) -> DataFrame:
    """A4: connected sources over all sources (disabled ones count in all)."""
    aggs = [F.count_if(F.col("state") == "connected").alias("connected"), F.count(F.lit(1)).alias("total")]
    return states.groupBy(*by).agg(*aggs) if by else states.agg(*aggs)


def client_counts(subscription_events: DataFrame, tiebreak=("subscription_id",)) -> DataFrame:
    """A5: open subscriptions after every event: all-source ones + per-source ones.

    A global running sum ordered by time, computed as a scan over buckets at quantiles of the event
    times (no single task holds the whole stream, nor a burst of it).
    """
    delta = F.when(F.col("opened"), F.lit(1)).otherwise(F.lit(-1))
    e = subscription_events.withColumn("_k", F.lit(0)).withColumn("_d", delta)
    e = e.withColumn("_da", F.when(F.col("source").isNull(), F.col("_d")).otherwise(F.lit(0)))
    s = ordered_scan(
        e,
        ["_k"],
        "at_ms",
        list(tiebreak),
        running_sum={"clients": F.col("_d"), "all_source_clients": F.col("_da")},
        rows_per_bucket=ROWS_PER_BUCKET,
    )
    return s.select(
        *[c for c in subscription_events.columns if c not in ("source", "opened")],
        "opened",
        "source",
        F.col("clients").cast("long"),
        F.col("all_source_clients").cast("long"),
        (F.col("clients") - F.col("all_source_clients")).cast("long").alias("per_source_clients"),
    )


def label_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a label column."""
    return df.select(col).distinct()


def error_totals(conn_events: DataFrame) -> DataFrame:
    """Per source, errors (failed connect or dropped connection) and reconnect
    waits (every wait, a clean close included)."""
    return conn_events.groupBy("source").agg(
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("state").isin("reconnect_wait", "reconnect_wait_degraded")).alias("reconnects"),
    )


def type_mix(frames: DataFrame, cube: bool = False) -> DataFrame:
    """Packets and bytes per source and payload type (null type is a group).

    ``cube=True`` adds the per-source, per-type and overall totals in the same pass;
    ``level`` tells them apart (a missing payload type stays distinguishable from a
    total row)."""
    aggs = [F.count(F.lit(1)).alias("packets"), F.sum("payload_bytes").alias("bytes")]
    if not cube:
        return frames.groupBy("source", "payload_type").agg(*aggs)
    g = frames.cube("source", "payload_type").agg(*aggs, F.grouping_id().alias("_gid"))
    level = (F.when(F.col("_gid") == 0, F.lit("source_type")).when(F.col("_gid") == 1, F.lit("source"))
             .when(F.col("_gid") == 2, F.lit("type")).otherwise(F.lit("all")))
    return g.select("source", "payload_type", level.alias("level"), "packets", "bytes")
