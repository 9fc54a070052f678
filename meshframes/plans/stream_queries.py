"""Streaming queries: a capture replayed as a file stream (ST1-ST5, D3).

Frames are written once as files of consecutive time ranges; each stream runs with
``availableNow`` over ``FILES_PER_BATCH`` files a micro-batch and its result is read back as a table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from meshframes import fixtures as fx
from meshframes.functions.scalars import payload_bytes
from meshframes.plans.health_queries import CATALOG_SQL, _catalog
from meshframes.plans.queries import _D2_SQL
from meshframes.plans.registry import query
from meshframes.plans.sql import DOC_FRAMES, FRAMES, PAGE_FRAMES, with_
from meshframes.session import configure, scratch_path
from meshframes.sources.frames import drop_control, read_frames
from meshframes.streaming import streams as st

FILES = 24
FILES_PER_BATCH = 8


def _stream(spark, sf_dir):
    configure(spark)
    frames = fx.frames_from_events(spark, sf_dir)
    path = scratch_path(spark, "frames-files")
    st.write_time_ordered(frames, path, FILES)
    return st.read_frames_stream(spark, path, frames.schema, max_files=FILES_PER_BATCH)


@query(
    "stream_rates",
    with_(FRAMES)
    + """select cast((received_at_ms // 1000) * 1000 as bigint) as window_start_ms, source,
       count(*) as packets, cast(sum(payload_bytes) as bigint) as bytes from frames group by 1, 2""",
)
def stream_rates(spark, sf_dir):
    """ST1: 1-second tumbling windows per source on the replayed stream."""
    return st.run_upserts(st.stream_rates(_stream(spark, sf_dir)), "stream-rates", ["window_start_ms", "source"])


@query(
    "stream_sliding",
    with_(FRAMES)
    + """select cast(start as bigint) as window_start_ms, source, count(*) as packets, cast(sum(payload_bytes) as bigint) as bytes
from (select *, (received_at_ms // 10000) * 10000 - k * 10000 as start
      from frames, unnest(range(0, 6)) as t(k)) x
where received_at_ms >= start and received_at_ms < start + 60000 group by 1, 2""",
)
def stream_sliding(spark, sf_dir):
    """ST2: 1-minute windows sliding by 10 seconds per source."""
    return st.run_upserts(st.stream_sliding(_stream(spark, sf_dir)), "stream-sliding", ["window_start_ms", "source"])


@query("stream_dedup", with_(FRAMES) + _D2_SQL)
def stream_dedup(spark, sf_dir):
    """D3 (ST3): aligned dedup with keyed state on the stream; equals D2 on ordered input."""
    return st.run_dedup(_stream(spark, sf_dir), "stream-dedup", 3600)[0].select("source", "sequence", "received_at_ms", "content_hash")


@query(
    "stream_union",
    with_(FRAMES, DOC_FRAMES, PAGE_FRAMES)
    + """select source, kind, count(*) as frames, cast(sum(payload_bytes) as bigint) as bytes from (
  select 'events' as source, kind, payload_bytes from frames
  union all select 'documents', kind, payload_bytes from doc_frames
  union all select 'pages', kind, payload_bytes from page_frames) t group by 1, 2""",
)
def stream_union(spark, sf_dir):
    """S1 on streams: three upstreams' folders read as one stream, control messages dropped."""
    configure(spark)
    upstreams = {"events": fx.raw_event_frames(spark, sf_dir), "documents": fx.frames_from_documents(spark, sf_dir), "pages": fx.frames_from_pages(spark, sf_dir)}
    paths = {}
    for name, frames in upstreams.items():
        paths[name] = scratch_path(spark, f"upstream-{name}")
        ping = frames.withColumn("kind", F.lit(9).cast("tinyint"))  # control messages among the frames
        frames.unionByName(ping).select("received_at_ms", F.col("kind").cast("tinyint").alias("kind"), "payload").write.parquet(paths[name])
    one = drop_control(read_frames(spark, paths, schema="received_at_ms long, kind tinyint, payload binary", streaming=True))
    merged = st.run_append(one.select("source", "kind", payload_bytes("payload").alias("n")), "stream-union")
    return merged.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("bytes"))


SUB_TYPES = {"all": None, "shop": ["SIGNUP", "PURCHASE"]}


@query(
    "stream_dedup_subs",
    with_(FRAMES)
    + """
, s as (select 'all' as sub, frames.* from frames
        union all select 'shop' as sub, frames.* from frames where payload_type in ('SIGNUP', 'PURCHASE'))
, g as (select *, received_at_ms // 3600000 as gen,
               row_number() over (partition by sub, content_hash, received_at_ms // 3600000 order by received_at_ms, source, sequence) as rn
        from s where content_hash is not null)
, f as (select * from g where rn = 1)
, l as (select *, lag(gen) over (partition by sub, content_hash order by gen) as pgen from f)
, r as (select *, max(case when pgen is null or gen - pgen > 1 then gen end)
                  over (partition by sub, content_hash order by gen rows between unbounded preceding and current row) as run_start
        from l)
select sub, source, sequence, received_at_ms, content_hash from r where (gen - run_start) % 2 = 0
union all select sub, source, sequence, received_at_ms, content_hash from s where content_hash is null
""",
)
def stream_dedup_subs(spark, sf_dir):
    """D3: two subscriptions with type filters of their own on one stream; each forgets and remembers for itself."""
    wants = [F.when(F.lit(True) if types is None else F.col("payload_type").isin(types), F.lit(sub)) for sub, types in SUB_TYPES.items()]
    subs = F.filter(F.array(*wants), lambda s: s.isNotNull())
    stream = _stream(spark, sf_dir).withColumn("sub", F.explode(subs))
    return st.run_dedup(stream, "stream-dedup-subs", 3600, sub="sub")[0].select("sub", "source", "sequence", "received_at_ms", "content_hash")


@query(
    "stream_late_rows",
    with_(FRAMES)
    + """select cast((received_at_ms // 3600000) * 3600000 as bigint) as window_start_ms, source,
       count(*) as packets, cast(sum(payload_bytes) as bigint) as bytes, cast(0 as bigint) as late_rows from frames group by 1, 2""",
)
def stream_late_rows(spark, sf_dir):
    """ST1 with the count of rows that came after their window was closed: none, as the capture is replayed in order."""
    out, batches = st.run_windows(_stream(spark, sf_dir), lambda f: st.stream_rates(f, "1 hour", "1 hour"), "stream-late")
    return out.crossJoin(batches.agg(F.coalesce(F.max("late_rows"), F.lit(0)).alias("late_rows")))


@query(
    "stream_dedup_first",
    with_(FRAMES)
    + """select source, sequence, received_at_ms, content_hash from (
  select *, row_number() over (partition by content_hash order by received_at_ms, source, sequence) as rn
  from frames where content_hash is not null) x where rn = 1
union all select source, sequence, received_at_ms, content_hash from frames where content_hash is null""",
)
def stream_dedup_first(spark, sf_dir):
    """D4 on the replayed stream: each hash once, as the watermark is wider than the capture; which copy of a micro-batch passes is
    Spark's choice, so its hash's first frame is looked up."""
    frames = fx.frames_from_events(spark, sf_dir)
    passed = st.run_append(st.dedup_first_stream(_stream(spark, sf_dir), "3650 days").select(*st.DEDUP_OUT), "stream-first")
    firsts = frames.where("content_hash is not null").groupBy("content_hash").agg(F.min(F.struct("received_at_ms", "source", "sequence")).alias("f"))
    own = passed.where("content_hash is not null").join(firsts, "content_hash").select("f.source", "f.sequence", "f.received_at_ms", "content_hash")
    return own.unionByName(passed.where("content_hash is null"))


@query(
    "stream_latest",
    with_(FRAMES)
    + """select source, max(sequence) as sequence, max(received_at_ms) as received_at_ms,
       arg_max(payload_type, sequence) as payload_type from frames group by 1""",
)
def stream_latest(spark, sf_dir):
    """ST4: latest frame per source, kept up to date per micro-batch."""
    return st.run_upserts(st.stream_latest(_stream(spark, sf_dir)), "stream-latest", ["source"])


@query(
    "stream_with_catalog",
    with_(FRAMES, CATALOG_SQL) + "select f.source, f.sequence, c.url, c.mapping from frames f join catalog c on f.source = c.id",
)
def stream_with_catalog(spark, sf_dir):
    """ST5: stream-static join with the source catalog."""
    s = st.stream_with_catalog(_stream(spark, sf_dir), _catalog(spark, sf_dir))
    return st.run_append(s.select("source", "sequence", "url", "mapping"), "stream-catalog")


@query("stream_stamp", with_(FRAMES) + "select source, sequence, received_at_ms, event_id from frames")
def stream_stamp(spark, sf_dir):
    """S2 on a stream: unstamped frames replayed; each source is numbered
    on across micro-batches."""
    configure(spark)
    raw = fx.raw_event_frames(spark, sf_dir).withColumnRenamed("_tb", "event_id")
    path = scratch_path(spark, "raw-files")
    st.write_time_ordered(raw, path, FILES)
    s = st.read_frames_stream(spark, path, raw.schema, max_files=FILES_PER_BATCH).select("source", "received_at_ms", "event_id")
    return st.run_stamp(s, "stream-stamp", tiebreak=["event_id"]).select(
        "source", "sequence", "received_at_ms", "event_id")
