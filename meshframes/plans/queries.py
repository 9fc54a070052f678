"""Registered queries over the driver's tables with DuckDB oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over whole tables. Column names
and types match the oracle SQL; doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshframes import fixtures as fx
from meshframes.operators import aggregates as agg
from meshframes.operators import dedup
from meshframes.operators import filters as flt
from meshframes.plans.registry import query
from meshframes.plans.sql import FRAMES, with_
from meshframes.session import configure


def _frames(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    configure(spark)
    return fx.frames_from_events(spark, sf_dir, **kw)


# --- flagship -------------------------------------------------------------------------
LIVE_TYPES = "click, VIEW,purchase"
LIVE_WINDOW_S = 3600


@query(
    "live_types_once_hourly",
    with_(FRAMES)
    + f"""
, typed as (select * from frames where payload_type in ('CLICK','VIEW','PURCHASE'))
, g as (select *, received_at_ms // {LIVE_WINDOW_S * 1000} as gen,
               row_number() over (partition by content_hash, received_at_ms // {LIVE_WINDOW_S * 1000}
                                  order by received_at_ms, source, sequence) as rn
        from typed where content_hash is not null)
, f as (select * from g where rn = 1)
, l as (select *, lag(gen) over (partition by content_hash order by gen) as pgen from f)
, r as (select *, max(case when pgen is null or gen - pgen > 1 then gen end)
                  over (partition by content_hash order by gen rows between unbounded preceding and current row) as run_start
        from l)
, kept as (select source, received_at_ms, payload_bytes from r where (gen - run_start) % 2 = 0
           union all select source, received_at_ms, payload_bytes from typed where content_hash is null)
select source, cast(floor(received_at_ms / 3600000) * 3600000 as bigint) as hour_ms,
       count(*) as packets, cast(sum(payload_bytes) as bigint) as bytes, max(received_at_ms) as last_packet_ms
from kept group by 1, 2
""",
)
def live_types_once_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen packet types, each content hash once per window, per source per hour."""
    # what the filter, the dedup and the totals need
    f = _frames(spark, sf_dir, columns=["source", "sequence", "received_at_ms", "payload_bytes", "payload_type", "content_hash"])
    f = flt.filter_payload_types(f, LIVE_TYPES)
    f = dedup.dedup_aligned(f, LIVE_WINDOW_S)
    return agg.source_totals(f, by_hour=True)


@query(
    "stamp_sequence",
    with_(FRAMES) + "select source, sequence, received_at_ms, event_id, payload_bytes from frames",
)
def stamp_sequence(spark, sf_dir):
    """Per-source arrival sequence."""
    f = _frames(spark, sf_dir, decode=False, keep_event_id=True)
    return f.select("source", "sequence", "received_at_ms", "event_id", "payload_bytes")


@query(
    "packet_meta",
    with_(FRAMES) + "select source, sequence, payload_type, content_hash, encoding from frames",
)
def packet_meta(spark, sf_dir):
    """Payload type (ASCII upper) and content hash of each frame."""
    return _frames(spark, sf_dir, write=False).select("source", "sequence", "payload_type", "content_hash", "encoding")


@query(
    "type_mix",
    with_(FRAMES)
    + "select source, payload_type, count(*) as packets, cast(sum(payload_bytes) as bigint) as bytes from frames group by 1, 2",
)
def type_mix(spark, sf_dir):
    """Packets and bytes per source and payload type."""
    return agg.type_mix(_frames(spark, sf_dir, write=False))


@query(
    "type_mix_cube",
    with_(FRAMES)
    + """select source, payload_type,
       case grouping(source, payload_type) when 0 then 'source_type' when 1 then 'source' when 2 then 'type' else 'all' end as level,
       count(*) as packets, cast(sum(payload_bytes) as bigint) as bytes
from frames group by cube (source, payload_type)""",
)
def type_mix_cube(spark, sf_dir):
    """A8 (cube): per source and type, per source, per type and overall in one pass."""
    return agg.type_mix(_frames(spark, sf_dir, write=False), cube=True)


@query(
    "source_totals",
    with_(FRAMES)
    + "select source, count(*) as packets, cast(sum(payload_bytes) as bigint) as bytes, max(received_at_ms) as last_packet_ms from frames group by 1",
)
def source_totals(spark, sf_dir):
    """A1."""
    return agg.source_totals(_frames(spark, sf_dir, decode=False))


@query(
    "relay_totals",
    with_(FRAMES) + "select count(*) as packets, cast(coalesce(sum(payload_bytes), 0) as bigint) as bytes from frames",
)
def relay_totals(spark, sf_dir):
    """A2."""
    return agg.relay_totals(_frames(spark, sf_dir, decode=False))


DEDUP_WINDOW_S = 3600

_D2_SQL = f"""
, g as (select *, received_at_ms // {DEDUP_WINDOW_S * 1000} as gen,
               row_number() over (partition by content_hash, received_at_ms // {DEDUP_WINDOW_S * 1000}
                                  order by received_at_ms, source, sequence) as rn
        from frames where content_hash is not null)
, f as (select * from g where rn = 1)
, l as (select *, lag(gen) over (partition by content_hash order by gen) as pgen from f)
, r as (select *, max(case when pgen is null or gen - pgen > 1 then gen end)
                  over (partition by content_hash order by gen rows between unbounded preceding and current row) as run_start
        from l)
select source, sequence, received_at_ms, content_hash from r where (gen - run_start) % 2 = 0
union all select source, sequence, received_at_ms, content_hash from frames where content_hash is null
"""


@query("dedup_aligned", with_(FRAMES) + _D2_SQL)
def dedup_aligned(spark, sf_dir):
    """Aligned two-generation dedup, W = 1 h."""
    f = _frames(spark, sf_dir, columns=["source", "sequence", "received_at_ms", "content_hash"])
    return dedup.dedup_aligned(f, DEDUP_WINDOW_S)


@query(
    "duplicate_report",
    with_(FRAMES)
    + """
, u as (select source, received_at_ms, content_hash from frames
        union all select source, doc_id, md5(text) from documents)
select content_hash, count(*) as copies, count(distinct source) as sources,
       min(received_at_ms) as first_seen_ms, max(received_at_ms) as last_seen_ms
from u where content_hash is not null group by 1
""",
)
def duplicate_report(spark, sf_dir):
    """D5 over packet frames and documents (hash = md5 of the text)."""
    f = _frames(spark, sf_dir, columns=["source", "received_at_ms", "content_hash"])
    docs = fx.table(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").alias("received_at_ms"), F.md5("text").alias("content_hash")
    )
    return dedup.duplicate_report(f.unionByName(docs))


BURST_S = 1800


@query(
    "duplicate_bursts",
    with_(FRAMES)
    + f"""
, m as (select *, coalesce(received_at_ms - lag(received_at_ms) over w >= {BURST_S * 1000}, false) as begins
        from frames where content_hash is not null window w as (partition by content_hash order by received_at_ms, source))
, b as (select *, cast(sum(case when begins then 1 else 0 end) over (partition by content_hash order by received_at_ms, source
                                                                   rows between unbounded preceding and current row) as bigint) as burst from m)
select content_hash, burst, count(*) as copies, count(distinct source) as sources,
       min(received_at_ms) as first_seen_ms, max(received_at_ms) as last_seen_ms from b group by 1, 2""",
)
def duplicate_bursts(spark, sf_dir):
    """D5 with a window: copies within half an hour of each other told from later repeats."""
    return dedup.duplicate_report(_frames(spark, sf_dir, columns=["source", "received_at_ms", "content_hash"]), BURST_S)


SUB_IDS = ("src-3", "src-1")
SUB_CSV = " src-5 ,src-1,, src-6"


@query(
    "subscribe_sources",
    with_(FRAMES)
    + "select source, sequence, received_at_ms from frames where source in ('src-3','src-1','src-5','src-6')",
)
def subscribe_sources(spark, sf_dir):
    """F1 P10: repeated ids then a comma list, checked against the catalog."""
    f = _frames(spark, sf_dir, decode=False)
    ids = flt.requested_ids(SUB_IDS, SUB_CSV)
    return flt.filter_sources(f, ids, fx.source_catalog(spark, sf_dir)).select("source", "sequence", "received_at_ms")


@query(
    "subscribe_types",
    with_(FRAMES) + "select source, sequence, payload_type from frames where payload_type in ('ERROR','SIGNUP')",
)
def subscribe_types(spark, sf_dir):
    """payload types in any case, blanks ignored."""
    f = _frames(spark, sf_dir, columns=["source", "sequence", "payload_type"])
    return flt.filter_payload_types(f, " error,, Signup ").select("source", "sequence", "payload_type")


_D1_SQL = with_(FRAMES).replace("with ", "with recursive ", 1) + f"""
, arr as (select distinct received_at_ms as ms from frames where content_hash is not null)
, rot(r, k) as (
    select min(ms), 0 from arr
    union all
    select (select min(ms) from arr where arr.ms >= rot.r + {DEDUP_WINDOW_S * 1000}), k + 1 from rot where r is not null)
, rots as (select r, k from rot where r is not null)
, gens as (select arr.ms, rots.k as gen from arr asof join rots on arr.ms >= rots.r)
, g as (select frames.*, gens.gen,
               row_number() over (partition by content_hash, gens.gen order by received_at_ms, source, sequence) as rn
        from frames join gens on frames.received_at_ms = gens.ms where content_hash is not null)
, f as (select * from g where rn = 1)
, l as (select *, lag(gen) over (partition by content_hash order by gen) as pgen from f)
, r as (select *, max(case when pgen is null or gen - pgen > 1 then gen end)
                  over (partition by content_hash order by gen rows between unbounded preceding and current row) as run_start
        from l)
select source, sequence, received_at_ms, content_hash from r where (gen - run_start) % 2 = 0
union all select source, sequence, received_at_ms, content_hash from frames where content_hash is null
"""


@query("dedup_replay", _D1_SQL)
def dedup_replay(spark, sf_dir):
    """The relay's arrival-driven two-generation dedup, W = 1 h, from the first arrival."""
    f = _frames(spark, sf_dir, columns=["source", "sequence", "received_at_ms", "content_hash"])
    return dedup.dedup_replay(f, DEDUP_WINDOW_S)


@query(
    "dedup_first",
    with_(FRAMES)
    + """select source, sequence, received_at_ms, content_hash from (
  select *, row_number() over (partition by content_hash order by received_at_ms, source, sequence) as rn
  from frames where content_hash is not null) x where rn = 1
union all select source, sequence, received_at_ms, content_hash from frames where content_hash is null""",
)
def dedup_first(spark, sf_dir):
    """D4 (batch form): first copy of each hash only."""
    f = _frames(spark, sf_dir, columns=["source", "sequence", "received_at_ms", "content_hash"])
    return dedup.dedup_first(f)
