"""Input tables derived from the driver's test tables by Spark.

Derived tables are written once per use as parquet under the shared checkpoint
folder and read back (``write_table``): they are the input tables of the data
model, so later plans read them with pushdown and never recompute their lineage.

The relay keeps connection changes, counters and process samples in memory; these
functions derive such tables from ``events``, ``documents``, ``pages`` and
``conversations`` so every query's work grows with the given data. Ordered numbering
and running totals use the bucketed ordered scan, never a window over one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meshframes.operators.scan import ordered_scan
from meshframes.session import scratch_path
from meshframes.sources.frames import decode_frames, stamp_frames


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_ms(ts: str = "ts") -> Column:
    """Epoch milliseconds of an event time (floored, UTC)."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _src(expr: Column) -> Column:
    return F.concat(F.lit("src-"), expr.cast("string"))


def event_payload() -> Column:
    """Packet JSON text of one event (type, hash and id taken from the event)."""
    return F.concat(
        F.lit('{"type":"packet","data":{"id":'),
        F.col("event_id").cast("string"),
        F.lit(',"hash":"'),
        F.col("event_type"),
        F.lit("-"),
        (F.col("user_id") % 10).cast("string"),
        F.lit('","decoded":{"header":{"payloadTypeName":"'),
        F.col("event_type"),
        F.lit('"}}}}'),
    )


def raw_event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unstamped frames from events: 8 sources, one JSON packet each."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        _src(F.col("user_id") % 8).alias("source"),
        event_ms().alias("received_at_ms"),
        F.col("event_id").alias("_tb"),
        F.lit(1).cast("tinyint").alias("kind"),
        event_payload().cast("binary").alias("payload"),
    )


def frames_from_events(spark: SparkSession, sf_dir: str, decode: bool = True, keep_event_id: bool = False, columns: Sequence[str] | None = None, write: bool = True) -> DataFrame:
    """Stamped (and decoded) frames from events.

    Decoded frames that are read more than once are written as a parquet table in the checkpoint folder and
    read back: payloads are parsed once, later filters on ``payload_type`` /
    ``content_hash`` reach the parquet scan, and the lineage is cut. ``columns`` are those that are written; with
    ``write=False`` frames that are read once, and not filtered by what decoding gives (Spark would decode for the filter and again
    for the result), are decoded as they are read, and only what is selected is computed.
    """
    f = stamp_frames(raw_event_frames(spark, sf_dir), tiebreak=["_tb"], keep_tiebreak=keep_event_id)
    if keep_event_id:
        f = f.withColumnRenamed("_tb", "event_id")
    if not decode:
        return f
    f = decode_frames(f)
    f = f.select(*columns) if columns else f
    return write_table(f, "frames") if write else f


def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source catalog (id, url, mapping, disabled) of the event frames; one source never sends, one is disabled."""
    k = (F.col("user_id") % 9).cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("src-"), k).alias("id"),
        F.concat(F.lit("wss://src-"), k, F.lit(".example/ws")).alias("url"),
        F.concat(F.lit("events:"), k).alias("mapping"),
        (F.col("user_id") % 9).isin(3, 8).alias("disabled"),
    ).distinct()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def frames_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text frames that are mostly not JSON: source column, doc_id as sequence."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("source"),
        F.col("doc_id").alias("sequence"),
        F.col("doc_id").alias("received_at_ms"),
        F.lit(1).cast("tinyint").alias("kind"),
        F.col("text").cast("binary").alias("payload"),
    )


def frames_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary frames: page html bytes, kind 2."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.lit("pages").alias("source"),
        F.col("page_id").alias("sequence"),
        F.col("page_id").alias("received_at_ms"),
        F.lit(2).cast("tinyint").alias("kind"),
        F.col("html").cast("binary").alias("payload"),
    )


def counters_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly cumulative packet/byte counters per source, reset every 10 days."""
    ev = table(spark, sf_dir, "events")
    ms = event_ms()
    hourly = ev.groupBy(
        _src(F.col("user_id") % 8).alias("source"),
        (F.floor(ms / 3600000).cast("long") * 3600000).alias("at_ms"),
        F.floor(ms / 864000000).cast("long").alias("seg"),
    ).agg(F.count(F.lit(1)).alias("p"), F.sum(F.length("props")).alias("b"))
    out = ordered_scan(
        hourly,
        ["source", "seg"],
        "at_ms",
        bucket_ms=86_400_000,
        running_sum={"packets": F.col("p"), "bytes": F.col("b")},
    )
    return write_table(out.select("source", "at_ms", F.col("packets").cast("long"), F.col("bytes").cast("long")), "counters")


def conn_events_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    return write_table(ev.select(
        _src(F.col("user_id") % 8).alias("source"),
        event_ms().alias("at_ms"),
        F.when(et == "error", F.lit("reconnect_wait"))
        .when(et == "signup", F.lit("connecting"))
        .when(et == "purchase", F.lit("disconnected"))
        .otherwise(F.lit("connected"))
        .alias("state"),
        F.when(et == "error", F.lit("upstream error")).alias("error"),
        F.col("event_id").alias("seq"),
    ), "conn_events")


def subscription_events_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", event_ms().alias("at_ms"))
    n = ordered_scan(ev, ["user_id"], "at_ms", ["event_id"], bucket_ms=86_400_000 * 7, row_number="_rn")
    return write_table(n.select(
        F.concat(F.lit("sub-"), F.col("user_id").cast("string")).alias("subscription_id"),
        "at_ms",
        ((F.col("_rn") + 1) % 2 == 1).alias("opened"),
        F.when(F.col("user_id") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(_src(F.col("user_id") % 8))
        .alias("source"),
        "event_id",
    ), "subscription_events")


# Constant process facts added to the derived samples.
PROCESS_OPEN_FDS = 64
PROCESS_MAX_FDS = 1024
PROCESS_START_TIME_S = 1704067200.0


def process_samples_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        F.concat(F.lit("i-"), (F.col("user_id") % 2).cast("string")).alias("instance"),
        event_ms().alias("at_ms"),
        "event_id",
        "value",
    )
    # summed as exact decimals (values carry two decimals), so every engine agrees
    s = ordered_scan(ev, ["instance"], "at_ms", ["event_id"], running_sum={"cpu_seconds": F.col("value").cast("decimal(18,2)")})
    return write_table(s.select(
        "instance",
        "at_ms",
        "event_id",
        F.col("cpu_seconds").cast("double"),
        (F.col("event_id") * 1000).alias("rss_bytes"),
        F.lit(PROCESS_OPEN_FDS).cast("long").alias("open_fds"),
        F.lit(PROCESS_MAX_FDS).cast("long").alias("max_fds"),
        F.lit(PROCESS_START_TIME_S).alias("start_time_s"),
    ), "process_samples")


def networks_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network directory in flat form: one row per analyzer with walk positions."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    url = (
        F.when(pid % 11 == 0, F.replace(F.replace(F.col("url"), F.lit("https:"), F.lit("ftp:")), F.lit("http:"), F.lit("ftp:")))
        .when(pid % 4 == 0, F.concat(F.col("url"), F.lit("/ws/")))
        .otherwise(F.col("url"))
    )
    a = p.select(
        F.concat(F.lit("net-"), (pid % 5).cast("string")).alias("network"),
        (pid % 5).alias("npos"),
        pid.alias("apos"),
        url.alias("url"),
    )
    b = p.filter(pid % 9 == 0).select(
        F.concat(F.lit("net-"), ((pid + 1) % 5).cast("string")).alias("network"),
        ((pid + 1) % 5).alias("npos"),
        (pid + 100000).alias("apos"),
        F.col("url"),
    )
    return a.unionByName(b)


def restarted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of sources whose numbers begin anew every 10 days, a fifth of them lost on the way."""
    ev = table(spark, sf_dir, "events").select(_src(F.col("user_id") % 8).alias("source"), event_ms().alias("received_at_ms"), "event_id")
    ev = ev.withColumn("seg", F.floor(F.col("received_at_ms") / 864000000).cast("long"))
    n = ordered_scan(ev, ["source", "seg"], "received_at_ms", ["event_id"], row_number="sequence")
    return write_table(n.filter((F.col("event_id") * 7) % 5 != 2).select("source", "sequence", "received_at_ms", "event_id"), "restarted-frames")


def conversation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.filter((F.col("conv_id") * 7 + F.col("turn")) % 5 != 2).select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source"),
        F.col("turn").alias("sequence"),
    )
