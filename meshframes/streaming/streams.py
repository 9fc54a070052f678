"""Structured Streaming forms of the frame operators (ST1-ST5, D3, D4).

Event time is ``received_at`` (TIMESTAMP, from ``received_at_ms``), so a replay of
a capture gives the same answer as the live stream. Windowed aggregations run in
update mode into a levelled, idempotent change log (``run_upserts``, ``run_windows``); the latest
version per key is the result table. Sinks and checkpoints live under the
session's shared checkpoint folder. Only ``dedup_stream`` runs Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from meshframes.operators.dedup import first_of_generations
from meshframes.operators.scan import ordered_scan, run_starts
from meshframes.session import materialize, scratch_path
from meshframes.sources.frames import STAMP_ROWS_PER_BUCKET
from meshframes.streaming.changelog import ChangeLog

KEPT_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"


def read_frames_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Frames files as a stream (parquet), with ``received_at`` event time."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    df = r.parquet(path)
    if "received_at" not in df.columns:
        df = df.withColumn("received_at", F.timestamp_millis("received_at_ms"))
    return df


def stream_rates(frames: DataFrame, window: str = "1 second", watermark: str = "10 seconds") -> DataFrame:
    """ST1: tumbling-window packets and bytes per source."""
    return (
        frames.withWatermark("received_at", watermark)
        .groupBy(F.window("received_at", window).alias("w"), "source")
        .agg(F.count(F.lit(1)).alias("packets"), F.sum("payload_bytes").alias("bytes"))
        .select(F.unix_millis("w.start").alias("window_start_ms"), "source", "packets", "bytes")
    )


def stream_sliding(frames: DataFrame, length: str = "1 minute", slide: str = "10 seconds", watermark: str = "1 minute") -> DataFrame:
    """ST2: sliding-window packets and bytes per source."""
    return (
        frames.withWatermark("received_at", watermark)
        .groupBy(F.window("received_at", length, slide).alias("w"), "source")
        .agg(F.count(F.lit(1)).alias("packets"), F.sum("payload_bytes").alias("bytes"))
        .select(F.unix_millis("w.start").alias("window_start_ms"), "source", "packets", "bytes")
    )


def stream_latest(frames: DataFrame, cols: Sequence[str] = ("sequence", "received_at_ms", "payload_type")) -> DataFrame:
    """ST4: latest frame per source (update mode)."""
    return frames.groupBy("source").agg(
        F.max_by(F.struct(*cols), F.struct("received_at_ms", "sequence")).alias("_l")
    ).select("source", *[F.col(f"_l.{c}").alias(c) for c in cols])


def stream_with_catalog(frames: DataFrame, catalog: DataFrame) -> DataFrame:
    """ST5: frames of catalog sources with their url and mapping (stream-static join, strategy by size estimate)."""
    return frames.join(catalog.select(F.col("id").alias("source"), "url", "mapping"), "source")


ORDER = ("received_at_ms", "source", "sequence")
DEDUP_OUT = [*ORDER, "content_hash"]


def _fresh(rows: DataFrame, keys: Sequence[str], state: DataFrame) -> DataFrame:
    """Generations (keys, _gen, ORDER) of a micro-batch that pass, given the last one that passed of each key (keys, _last)."""
    later = rows.join(state, list(keys), "left").where(F.col("_last").isNull() | (F.col("_gen") > F.col("_last"))).drop("_last")
    # the last one that passed stands before the batch's own, so runs and their parity go on across batches
    held = state.join(later.select(*keys).distinct(), list(keys), "left_semi").select(*keys, F.col("_last").alias("_gen"))
    both = later.unionByName(held, allowMissingColumns=True)
    ranked = run_starts(materialize(both, "dedup-generations"), list(keys), "_gen", "_run_start")
    return ranked.where(F.col("received_at_ms").isNotNull() & ((F.col("_gen") - F.col("_run_start")) % 2 == 0)).drop("_run_start")


def run_dedup(frames: DataFrame, name: str, window_s: int, sub: str | None = None, delay_s: int | None = None) -> tuple[DataFrame, DataFrame]:
    """D3: aligned two-generation dedup on a stream, by (``sub``, content_hash), run to completion; frames without a hash pass.

    Returns the frames that pass (``sub``, source, sequence, received_at_ms, content_hash) and a row a micro-batch: batch_id, watermark_ms, rows and
    late_rows. Of a micro-batch every (sub, hash, generation) is first reduced to its first frame by a partial
    aggregation, so a hot hash is a row a generation and task; the last generation that passed of each key is kept in a
    :class:`ChangeLog`, whose rows are dropped once the watermark has left the two generations in which they matter. Frames
    from before the watermark (largest time of earlier micro-batches less ``delay_s``, by default the window) are counted and left out.

    Frames are judged as they arrive: equal to the batch D2 when each micro-batch is later in time than the one before."""
    spark = frames.sparkSession
    base, w_ms = scratch_path(spark, name), int(window_s) * 1000
    delay = (int(window_s) if delay_s is None else int(delay_s)) * 1000
    keys = [*([sub] if sub else []), "content_hash"]
    cols = [*([sub] if sub else []), *DEDUP_OUT]
    marks = {-1: None}  # watermark after each batch; written beside the result, a row a batch

    def live(batch: int) -> Column:
        mark = marks[batch]
        return F.lit(True) if mark is None else (F.col("_last") + 2) * w_ms > mark

    types = {f.name: f for f in frames.schema}
    state = ChangeLog(spark, f"{base}/state", T.StructType([*(types[k] for k in keys), T.StructField("_last", T.LongType())]), keys, live=live)
    out_schema = T.StructType([types[c] for c in cols])
    progress = "batch_id long, watermark_ms long, rows long, late_rows long, next_ms long"

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id - 1 not in marks:  # the stream was started again
            marks[batch_id - 1] = spark.read.schema(progress).parquet(f"{base}/progress/batch_id={batch_id - 1}").first()["next_ms"]
        mark = marks[batch_id - 1]
        batch.select(cols).write.mode("overwrite").parquet(f"{base}/in/batch_id={batch_id}")  # read twice
        rows = spark.read.schema(out_schema).parquet(f"{base}/in/batch_id={batch_id}")
        is_late = F.lit(False) if mark is None else F.coalesce(F.col("received_at_ms") < mark, F.lit(False))
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_late).alias("late"), F.max("received_at_ms").alias("top")).first()
        tops = [x for x in (mark, None if seen["top"] is None else seen["top"] - delay) if x is not None]
        marks[batch_id] = max(tops, default=None)
        spark.createDataFrame([(batch_id, mark, seen["n"], seen["late"], marks[batch_id])], progress).coalesce(1).write.mode("overwrite").parquet(f"{base}/progress/batch_id={batch_id}")
        timely = rows.where(~is_late)
        gen = F.floor(F.col("received_at_ms") / w_ms).cast("long").alias("_gen")
        firsts = first_of_generations(timely.where("content_hash is not null").select(*cols, gen), keys)
        passed = materialize(_fresh(firsts, keys, state.read(batch_id - 1)), "dedup-passed")
        passed.select(cols).unionByName(timely.where("content_hash is null").select(cols)).write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")
        state.write(passed.groupBy(*keys).agg(F.max("_gen").alias("_last")), batch_id)

    _finish(frames.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/ckpt"))
    if len(marks) == 1:
        return spark.createDataFrame([], out_schema), spark.createDataFrame([], progress).drop("next_ms")
    return spark.read.schema(out_schema).parquet(f"{base}/out"), spark.read.schema(progress).parquet(f"{base}/progress").drop("next_ms")


_KEYED_OUT = "source string, sequence bigint, received_at_ms bigint, content_hash string"


def _dedup_fn(window_ms: int):
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        order = ["received_at_ms", "source", "sequence"]
        firsts = None  # the first row of each generation so far: what is kept does not grow with a hot hash's rows
        for pdf in pdfs:
            some = pdf.assign(_g=pdf["received_at_ms"].to_numpy() // window_ms)
            firsts = (some if firsts is None else pd.concat([firsts, some])).sort_values(order, kind="stable").drop_duplicates("_g", keep="first")
        if firsts is None or firsts.empty:
            return
        admitted = []
        for g in firsts["_g"]:  # distinct generations of this batch, in time order
            if last is None or g >= last + 2:
                admitted.append(g)
                last = int(g)
        firsts = firsts[firsts["_g"].isin(admitted)]
        state.update((int(last),))
        state.setTimeoutTimestamp(max((int(last) + 2) * window_ms, state.getCurrentWatermarkMs() + 1))
        if not firsts.empty:
            yield firsts[["source", "sequence", "received_at_ms", "content_hash"]]

    return fn


def dedup_stream(frames: DataFrame, window_s: int, watermark: str | None = None) -> DataFrame:
    """D3: aligned two-generation dedup on a stream (state = last admitted
    generation per hash, dropped by event-time timeout). Frames without a hash pass.

    Rows are judged as they arrive: equal to the batch D2 when each micro-batch is
    later in time than the previous one. For use inside a longer streaming plan; a hot hash's rows of one micro-batch are read by one
    task, which :func:`run_dedup` avoids.
    """
    w_ms = int(window_s) * 1000
    wm = watermark or f"{int(window_s)} seconds"
    f = frames.withWatermark("received_at", wm)
    hashed = f.filter(F.col("content_hash").isNotNull()).select("source", "sequence", "received_at_ms", "content_hash", "received_at")
    out = hashed.groupBy("content_hash").applyInPandasWithState(
        _dedup_fn(w_ms), _KEYED_OUT, "last_gen bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    nulls = f.filter(F.col("content_hash").isNull()).select("source", "sequence", "received_at_ms", "content_hash")
    return out.unionByName(nulls)


def dedup_first_stream(frames: DataFrame, watermark: str = "300 seconds") -> DataFrame:
    """Spark's dropDuplicatesWithinWatermark on the content hash (looser bound
    than D3; its own operator, not a stand-in for the relay's rule)."""
    f = frames.withWatermark("received_at", watermark)
    hashed = f.filter(F.col("content_hash").isNotNull()).dropDuplicatesWithinWatermark(["content_hash"])
    return hashed.unionByName(f.filter(F.col("content_hash").isNull()))


def run_stamp(raw: DataFrame, name: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """S2 on a stream whose frames carry no sequence, run to completion: each micro-batch is numbered by the bucketed
    ordered scan of the batch operator (arrival order is ``received_at_ms`` then ``tiebreak``), and every source goes on from
    where the batch before left it. Frames and next numbers of a batch are written to folders of its own, so a rerun
    overwrites them with the same rows. The table of next numbers has a row for each source."""
    spark = raw.sparkSession
    base = scratch_path(spark, name)
    cols, schema = list(raw.columns), raw.schema
    numbers = "source string, next long"

    def before(batch_id: int) -> DataFrame:
        return spark.read.schema(numbers).parquet(f"{base}/next/batch_id={batch_id - 1}") if batch_id else spark.createDataFrame([], numbers)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(cols).write.mode("overwrite").parquet(f"{base}/raw/batch_id={batch_id}")
        own = spark.read.schema(schema).parquet(f"{base}/raw/batch_id={batch_id}")  # scanned twice
        part = ordered_scan(own, ["source"], "received_at_ms", list(tiebreak), row_number="_n", rows_per_bucket=STAMP_ROWS_PER_BUCKET)
        old = before(batch_id)
        part.join(old, "source", "left").select(*cols, (F.col("_n") + F.coalesce("next", F.lit(0))).cast("long").alias("sequence")).write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")
        counts = own.groupBy("source").agg(F.count(F.lit(1)).alias("next")).union(old)
        counts.groupBy("source").agg(F.sum("next").alias("next")).write.mode("overwrite").parquet(f"{base}/next/batch_id={batch_id}")

    _finish(raw.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/ckpt"))
    return spark.read.schema(T.StructType([*schema, T.StructField("sequence", T.LongType())])).parquet(f"{base}/out")


def _finish(writer) -> StreamingQuery:
    """Run a stream over all there is."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to completion (availableNow) into a parquet sink
    under the checkpoint folder; return the sink as a table."""
    spark = stream.sparkSession
    sink, ckpt = scratch_path(spark, f"{name}-sink"), scratch_path(spark, f"{name}-ckpt")
    _finish(stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).outputMode("append"))
    return spark.read.schema(stream.schema).parquet(sink)


def _upserted(stream: DataFrame, name: str, keys: Sequence[str]) -> tuple[DataFrame, StreamingQuery]:
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    log = ChangeLog(spark, f"{base}/log", stream.schema, keys)
    last = [-1]

    def write(batch: DataFrame, batch_id: int) -> None:
        log.write(batch, batch_id)
        last[0] = batch_id

    q = _finish(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/ckpt").outputMode("update"))
    return log.read(last[0]).select(stream.columns), q


def run_upserts(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run an update-mode stream to completion; every batch adds its changed rows to a :class:`ChangeLog`
    (a rerun overwrites the same folders: idempotent). The result is the last version of each key."""
    return _upserted(stream, name, keys)[0]


def run_windows(frames: DataFrame, rates: Callable[[DataFrame], DataFrame], name: str, windows_a_row: int = 1) -> tuple[DataFrame, DataFrame]:
    """Run :func:`stream_rates` or :func:`stream_sliding` (``rates``) to completion and count what came too late.

    Returns the windows and a row a micro-batch: batch_id, watermark_ms, rows read, and dropped_groups, the (window, source) groups that Spark
    dropped as their window lay before the watermark. ``late_rows``, on every row, is the exact number of
    (row, window) pairs left out of the whole result: the pairs read less the packets counted."""
    spark = frames.sparkSession
    before = spark.conf.get(KEPT_PROGRESS)
    spark.conf.set(KEPT_PROGRESS, "100000")  # a small record for each micro-batch
    try:
        out, q = _upserted(rates(frames.observe("read", F.count_if(F.col("received_at").isNotNull()).alias("rows"))), name, ["window_start_ms", "source"])
        seen = q.recentProgress
    finally:
        spark.conf.set(KEPT_PROGRESS, before)
    rows = []
    for p in seen:
        mark = (p["eventTime"] or {}).get("watermark")
        got = (p["observedMetrics"] or {}).get("read")
        rows.append((p["batchId"], None if mark is None else _iso_ms(mark), got["rows"] if got else 0, sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])))
    counted = out.agg(F.sum("packets")).first()[0] or 0
    batches = spark.createDataFrame(rows, "batch_id long, watermark_ms long, rows long, dropped_groups long")
    return out, batches.withColumn("late_rows", F.lit(sum(r[2] for r in rows) * windows_a_row - counted).cast("long"))


def _iso_ms(text: str) -> int:
    return round(datetime.fromisoformat(text).timestamp() * 1000)


def write_time_ordered(frames: DataFrame, path: str, files: int = 24) -> None:
    """Write frames once, as up to ``files`` files that each hold one range of ``received_at_ms``, and date the files in that order.

    A file stream takes files by modification time, so whatever ``maxFilesPerTrigger`` is, each
    micro-batch is later in time than the one before. Frames of one millisecond stay in one file. The path needs a file system
    that keeps modification times (HDFS, a local or mounted one)."""
    spark = frames.sparkSession
    frames.repartitionByRange(files, "received_at_ms").write.mode("errorifexists").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f.getPath().getName(), f) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    first = min((f.getModificationTime() for _, f in parts), default=0) // 1000 * 1000 - 1000 * len(parts)
    for i, (_, f) in enumerate(parts):  # file names only: a call for each file, no data
        fs.setTimes(f.getPath(), first + 1000 * i, -1)
