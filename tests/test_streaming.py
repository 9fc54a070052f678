"""Streams replayed from time-ordered files equal the batch operators."""

import pytest
from pyspark.sql import functions as F

from meshframes import fixtures as fx
from meshframes.operators.dedup import dedup_aligned
from meshframes.session import scratch_path
from meshframes.streaming import streams as st
from tests.conftest import SF_SMALL

DAY = 86_400_000


@pytest.fixture(scope="module")
def replay(spark):
    frames = fx.frames_from_events(spark, SF_SMALL)
    path = scratch_path(spark, "test-frames-files")
    st.write_time_ordered(frames, path, files=7)
    return frames, path, 3


def _stream(spark, replay):
    frames, path, k = replay
    return st.read_frames_stream(spark, path, frames.schema, max_files=k)


def _ids(df):
    return sorted((r["source"], r["sequence"]) for r in df.select("source", "sequence").collect())


def test_dedup_stream_equals_aligned_batch(spark, replay):
    frames = replay[0]
    out = st.run_append(st.dedup_stream(_stream(spark, replay), 3600), "t-dedup")
    assert _ids(out) == _ids(dedup_aligned(frames, 3600))


def test_stream_rates_equal_batch_counts(spark, replay):
    frames = replay[0]
    out = st.run_upserts(st.stream_rates(_stream(spark, replay), "1 hour", "1 hour"), "t-rates", ["window_start_ms", "source"])
    ref = frames.groupBy((F.floor(F.col("received_at_ms") / 3_600_000) * 3_600_000).cast("long").alias("window_start_ms"), "source").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("payload_bytes").alias("bytes"))
    assert out.exceptAll(ref).count() == 0 and ref.exceptAll(out).count() == 0


def test_stream_latest_and_catalog(spark, replay):
    frames = replay[0]
    latest = st.run_upserts(st.stream_latest(_stream(spark, replay)), "t-latest", ["source"])
    ref = frames.groupBy("source").agg(F.max("sequence").alias("sequence"))
    assert sorted((r["source"], r["sequence"]) for r in latest.collect()) == sorted(tuple(r) for r in ref.collect())
    cat = spark.createDataFrame([("src-1", "wss://1/ws", "m1"), ("src-2", "wss://2/ws", "m2")], "id string, url string, mapping string")
    joined = st.run_append(st.stream_with_catalog(_stream(spark, replay), cat).select("source", "sequence", "url"), "t-cat")
    assert joined.count() == frames.filter(F.col("source").isin("src-1", "src-2")).count()


def test_drop_duplicates_within_watermark_runs(spark, replay):
    frames = replay[0]
    out = st.run_append(st.dedup_first_stream(_stream(spark, replay), "300 seconds").select(
        "source", "sequence", "received_at_ms", "content_hash"), "t-d4")
    want = []
    for r in frames.orderBy("received_at_ms", "source", "sequence").collect():
        if r["content_hash"] is None:
            want.append((r["source"], r["sequence"]))
    got = out.collect()
    assert sorted((r["source"], r["sequence"]) for r in got if r["content_hash"] is None) == sorted(want)
    firsts = {r["content_hash"]: r["received_at_ms"] for r in frames.groupBy("content_hash").agg(F.min("received_at_ms").alias("received_at_ms")).collect()}
    seen = {}
    for r in got:
        seen.setdefault(r["content_hash"], []).append(r["received_at_ms"])
    assert seen.keys() == firsts.keys() and len(got) == out.select("source", "sequence").distinct().count()


def test_stamp_stream_continues_across_batches(spark, replay):
    frames = replay[0]
    raw = _stream(spark, replay).select("source", "received_at_ms", "payload_bytes", F.col("sequence").alias("orig"))
    out = st.run_stamp(raw, "t-stamp", tiebreak=["orig"])
    got = out.select("source", "orig", "sequence")
    assert got.filter(F.col("orig") != F.col("sequence")).count() == 0
    assert got.count() == frames.count()


def test_windows_over_shuffled_splits_equal_batch(spark, replay):
    """Files replayed newest first: with a watermark wider than the data no row is
    late, so the tumbling-window counts equal the batch counts."""
    frames = replay[0]
    path = scratch_path(spark, "test-reversed-files")
    chunk = F.floor(F.col("received_at_ms") / (2 * DAY)).cast("long")
    for r in frames.select(chunk.alias("c")).distinct().orderBy(F.col("c").desc()).collect():
        frames.filter(chunk == r["c"]).repartition(2).write.mode("append").parquet(path)
    s = st.read_frames_stream(spark, path, frames.schema, max_files=3)
    out = st.run_upserts(st.stream_rates(s, "1 hour", "3650 days"), "t-rev", ["window_start_ms", "source"])
    ref = frames.groupBy((F.floor(F.col("received_at_ms") / 3_600_000) * 3_600_000).cast("long").alias("window_start_ms"), "source").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("payload_bytes").alias("bytes"))
    assert out.exceptAll(ref).count() == 0 and ref.exceptAll(out).count() == 0


def _frames_of(spark, rows):
    return spark.createDataFrame(rows, "sub string, source string, sequence long, received_at_ms long, content_hash string")


def _as_stream(spark, batches, name):
    """A stream that takes each list of rows as a micro-batch."""
    path = scratch_path(spark, name)
    for i, rows in enumerate(batches):
        _frames_of(spark, rows).coalesce(1).write.parquet(f"{path}/{i:04d}")
    import os

    files = sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))
    for i, f in enumerate(files):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    schema = _frames_of(spark, []).schema
    return st.read_frames_stream(spark, f"{path}/*", schema, max_files=1)


def _relay_rule(batches, w_ms, delay_ms):
    """Row by row: two aligned generations for each (sub, hash), late rows of earlier batches left out."""
    last, mark, out, late = {}, None, [], 0
    for rows in batches:
        seen = [r for r in rows if mark is None or r[3] >= mark]
        late += len(rows) - len(seen)
        for sub, source, seq, ms, h in sorted(seen, key=lambda r: (r[3], r[1], r[2])):
            gen = ms // w_ms
            if h is None or (sub, h) not in last or gen >= last[sub, h] + 2:
                out.append((sub, source, seq))
                if h is not None:
                    last[sub, h] = gen
        if rows:
            mark = max([x for x in (mark, max(r[3] for r in rows) - delay_ms) if x is not None])
    return sorted(out), late


def test_dedup_by_subscription_follows_the_rule_batch_by_batch(spark):
    import random

    r = random.Random(4)
    batches, seq = [], 0
    for b in range(12):
        rows = []
        for _ in range(60):
            ms = b * 2_500 + r.randrange(4_000) - (9_000 if r.random() < 0.05 else 0)  # batches overlap, some rows are late
            rows.append((r.choice(["a", "b"]), f"s{r.randrange(3)}", seq, max(0, ms), r.choice(["hot"] * 6 + ["x", "y", None])))
            seq += 1
        batches.append(rows)
    stream = _as_stream(spark, batches, "t-subs-files")
    out, progress = st.run_dedup(stream, "t-subs", 1, sub="sub", delay_s=6)
    want, late = _relay_rule(batches, 1000, 6000)
    assert sorted((x["sub"], x["source"], x["sequence"]) for x in out.collect()) == want
    assert late > 0 and progress.agg(F.sum("late_rows")).first()[0] == late
    assert progress.agg(F.sum("rows")).first()[0] == 720


def test_dedup_of_a_hot_hash_ships_one_row_a_generation(spark):
    rows = [(None, f"s{i % 7}", i, i * 3, "hot" if i % 10 else f"h{i}") for i in range(20_000)]
    stream = _as_stream(spark, [rows], "t-hot-files")
    out = st.run_dedup(stream, "t-hot", 1)[0]
    assert sorted(x["sequence"] for x in out.where("content_hash = 'hot'").collect()) == [min(i for i in range(20_000) if i % 10 and i * 3 // 1000 == g) for g in range(0, 60, 2)]
    assert out.where("content_hash <> 'hot'").count() == 2_000
    from meshframes.operators.dedup import first_of_generations

    firsts = first_of_generations(_frames_of(spark, rows[:100]).withColumn("_gen", F.lit(0)), ["content_hash"])
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_late_rows_of_windows_are_counted(spark, replay):
    frames = replay[0]
    path = scratch_path(spark, "test-late-files")
    st.write_time_ordered(frames, path, files=6)
    top = frames.agg(F.max("received_at_ms")).first()[0]
    early = frames.where(F.col("received_at_ms") < top - 5 * DAY).limit(37).withColumn("sequence", F.col("sequence") + 1_000_000)
    early.coalesce(1).write.mode("append").parquet(path)
    import glob
    import os

    newest = max(glob.glob(f"{path}/*.parquet"), key=os.path.getctime)
    os.utime(newest, (4_000_000_000, 4_000_000_000))
    stream = st.read_frames_stream(spark, path, frames.schema, max_files=2)
    out, batches = st.run_windows(stream, lambda f: st.stream_rates(f, "1 hour", "1 hour"), "t-late")
    assert out.agg(F.sum("packets"), F.sum("bytes")).first() == frames.agg(F.count(F.lit(1)), F.sum("payload_bytes")).first()
    rows = batches.collect()
    assert {x["late_rows"] for x in rows} == {37} and sum(x["rows"] for x in rows) == frames.count() + 37
    assert sum(x["dropped_groups"] for x in rows) > 0


def test_change_log_reads_a_bounded_number_of_runs(spark):
    from meshframes.streaming.changelog import ChangeLog

    base = scratch_path(spark, "t-log")
    log = ChangeLog(spark, base, spark.createDataFrame([], "k long, v long").schema, ["k"], fan=3)
    want = {}
    sizes = []
    for b in range(40):
        rows = [(k, 100 * b + k) for k in range(6) if (b + k) % 3 == 0 or b == 0]
        want.update(rows)
        log.write(spark.createDataFrame(rows, "k long, v long").coalesce(1), b)
        if b in (4, 20):  # a micro-batch that runs again
            log.write(spark.createDataFrame(rows, "k long, v long").coalesce(1), b)
        sizes.append(len(log.runs(b)))
    assert {r["k"]: r["v"] for r in log.read(39).collect()} == want
    assert max(sizes[20:]) <= 8 and max(sizes) <= 8
    import os

    assert len([d for d in os.listdir(base) if d.startswith("level")]) <= 8 + 3 * 4  # merged runs are gone
    live = ChangeLog(spark, scratch_path(spark, "t-live"), spark.createDataFrame([], "k long, v long").schema, ["k"], fan=3, live=lambda b: F.col("v") > b)
    for b in range(7):
        live.write(spark.createDataFrame([(b, b + 2)], "k long, v long").coalesce(1), b)
    assert sorted(r["k"] for r in live.read(6).collect()) == [5, 6]
