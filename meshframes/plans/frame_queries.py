"""Queries over the frame path: envelope, projection, programs, subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshframes import fixtures as fx
from meshframes.functions import scalars as sc
from meshframes.operators.program import Each, Program, Project, Reshape, Select, run_program
from meshframes.operators.subscribe import subscribe
from meshframes.plans.registry import query
from meshframes.plans.sql import DOC_FRAMES, FRAMES, PAGE_FRAMES, envelope, json_line, with_
from meshframes.schema import Subscription
from meshframes.session import configure, scratch_path
from meshframes.sources import envelope as env
from meshframes.sources.frames import decode_frames, raw_source as raw_source_op, union_frames
from meshframes.sources.output import to_json_lines


def _events(spark, sf_dir, **kw):
    configure(spark)
    return fx.frames_from_events(spark, sf_dir, **kw)


def _docs(spark, sf_dir):
    return decode_frames(fx.frames_from_documents(spark, sf_dir).withColumn("payload_bytes", sc.payload_bytes("payload")))


@query(
    "envelope_roundtrip",
    with_(FRAMES)
    + f"""select source, sequence, received_at_ms, kind, md5(encode(payload_text)) as payload_md5,
       false as trailing_bytes,
       md5({envelope('source', 'sequence', 'received_at_ms', 'kind', 'encode(payload_text)')}) as envelope_md5
from frames""",
)
def envelope_roundtrip(spark, sf_dir):
    """S3 then S4: frames written as envelope records and read back unchanged."""
    f = _events(spark, sf_dir, decode=False)
    path = scratch_path(spark, "capture")
    env.to_capture(f).write.parquet(path)
    capture = spark.read.parquet(path)
    dec = env.decode_envelopes(capture).filter(F.col("reason").isNull())
    return dec.select(
        "source", "sequence", "received_at_ms", "kind", F.md5("payload").alias("payload_md5"),
        "trailing_bytes", F.md5("envelope").alias("envelope_md5"),
    )


_Q_CASE = "doc_id % 7"


@query(
    "envelope_quarantine",
    with_(DOC_FRAMES.replace("doc_frames as (", "d as (").replace("doc_id as sequence", "doc_id, doc_id as sequence"))
    + """select doc_id,
       case doc_id % 7 when 1 then 'truncated' when 2 then 'bad_magic' when 3 then 'short'
            when 5 then 'bad_source_utf8' when 6 then 'sequence_range' end as reason,
       case when doc_id % 7 in (0, 4) then source end as source,
       case when doc_id % 7 in (0, 4) then sequence end as sequence,
       case when doc_id % 7 in (0, 4) then md5(encode(payload_text)) end as payload_md5,
       case when doc_id % 7 in (0, 4) then doc_id % 7 = 4 end as trailing_bytes
from d""",
)
def envelope_quarantine(spark, sf_dir):
    """S4 on damaged records: cut, bad magic, short, trailing bytes, bad source, range."""
    configure(spark)
    d = fx.frames_from_documents(spark, sf_dir).withColumn("doc_id", F.col("sequence"))
    case = F.col("doc_id") % 7
    src = F.when(case == 5, F.unhex(F.lit("C328"))).otherwise(F.col("source").cast("binary"))
    seq = F.when(case == 6, F.lit(-1).cast("long")).otherwise(F.col("sequence"))
    e = env.envelope(src, seq, F.col("received_at_ms"), F.col("kind"), F.col("payload"))
    n = F.octet_length(e)
    damaged = (
        F.when(case == 1, F.substring(e, F.lit(1), n - 2))
        .when(case == 2, F.concat(F.lit("X").cast("binary"), F.substring(e, F.lit(2), n)))
        .when(case == 3, F.substring(e, 1, 20))
        .when(case == 4, F.concat(e, F.lit("zz").cast("binary")))
        .otherwise(e)
    )
    capture = d.select("doc_id", damaged.alias("envelope"))
    dec = env.decode_envelopes(capture)
    return dec.select(
        "doc_id", "reason", "source", "sequence", F.md5("payload").alias("payload_md5"), "trailing_bytes"
    )


@query(
    "encoding_mix",
    with_(FRAMES, DOC_FRAMES, PAGE_FRAMES)
    + """select source, sequence, kind, encoding, payload_bytes, md5(payload_text) as text_md5 from frames
union all select source, sequence, kind, encoding, payload_bytes, md5(payload_text) from doc_frames
union all select source, sequence, kind, encoding, payload_bytes, md5(payload_text) from page_frames""",
)
def encoding_mix(spark, sf_dir):
    """Json / utf8 / base64 projection of JSON, text and binary frames."""
    configure(spark)
    raw = union_frames(
        fx.frames_from_events(spark, sf_dir, decode=False).select("source", "sequence", "received_at_ms", "kind", "payload"),
        fx.frames_from_documents(spark, sf_dir),
        fx.frames_from_pages(spark, sf_dir),
    )
    f = decode_frames(raw.withColumn("payload_bytes", sc.payload_bytes("payload")))
    return f.select("source", "sequence", "kind", "encoding", "payload_bytes", F.md5("payload_text").alias("text_md5"))


@query(
    "json_lines",
    with_(FRAMES, DOC_FRAMES)
    + f"""select source, sequence, md5(m) as message_md5, cast(strlen(m) as bigint) as message_bytes from (
  select source, sequence, {json_line('source', 'sequence', 'received_at_ms', 'kind', 'encoding', 'payload_text')} as m from frames
  union all
  select source, sequence, {json_line('source', 'sequence', 'received_at_ms', 'kind', 'encoding', 'payload_text')} from doc_frames) t""",
)
def json_lines(spark, sf_dir):
    """Projection text of packet and text frames."""
    f = union_frames(_events(spark, sf_dir, write=False), _docs(spark, sf_dir))
    out = to_json_lines(f)
    return out.select(
        "source", "sequence", F.md5("message").alias("message_md5"), F.octet_length("message").cast("long").alias("message_bytes")
    )


def _program_input(spark, sf_dir):
    cols = ["source", "sequence", "received_at_ms", "kind", "encoding", "payload_text", "payload_v"]
    return union_frames(_events(spark, sf_dir, write=False).select(*cols), _docs(spark, sf_dir).select(*cols))


@query(
    "project_path",
    with_(FRAMES) + "select source, sequence, to_json(json_extract_string(payload_text, '$.data.hash'))::varchar as message from frames",
)
def project_path(spark, sf_dir):
    """``.payload.data.hash``; text frames error (path through a string) and are skipped."""
    return run_program(_program_input(spark, sf_dir), Program(Project(".payload.data.hash")))


@query(
    "reshape",
    with_(FRAMES)
    + """select source, sequence,
       '{"h":' || to_json(json_extract_string(payload_text, '$.data.hash')) || ',"t":'
       || to_json(json_extract_string(payload_text, '$.data.decoded.header.payloadTypeName'))
       || ',"src":' || to_json(source) || ',"missing":null}' as message
from frames""",
)
def reshape(spark, sf_dir):
    """New object from chosen paths, missing path -> null."""
    prog = Program(Reshape({"h": ".payload.data.hash", "t": ".payload.data.decoded.header.payloadTypeName",
                            "src": ".source", "missing": ".payload.nope"}))
    return run_program(_program_input(spark, sf_dir), prog)


@query(
    "explode_path",
    with_(FRAMES)
    + """select source, sequence, cast(json_extract(payload_text, '$.data.id') as varchar) as message from frames
union all select source, sequence, to_json(json_extract_string(payload_text, '$.data.hash'))::varchar from frames
union all select source, sequence, cast(json_extract(payload_text, '$.data.decoded') as varchar) from frames""",
)
def explode_path(spark, sf_dir):
    """``.payload.data[]`` - one message per value; text frames error and drop."""
    return run_program(_program_input(spark, sf_dir), Program(Each(".payload.data")))


def _json_message(id_: str, url: str) -> tuple:
    """A nested object with unsorted keys, as a maker of a Spark column and DuckDB SQL of equal text."""
    parts = ['{"z":{"n":', id_, ',"a":[', id_, ',{"y":"', url, '","it\'s":', id_, '}]},"b":{"q":true,"c":null},"a":"', url, '"}']
    return (lambda: F.concat(*[F.col(p).cast("string") if p in (id_, url) else F.lit(p) for p in parts])), " || ".join(p if p in (id_, url) else "'" + p.replace("'", "''") + "'" for p in parts)


_PAGE_MESSAGE, _PAGE_MESSAGE_SQL = _json_message("page_id", "address")
_PAGES_SQL = "with p as (select page_id, replace(replace(coalesce(url, ''), chr(92), ''), chr(34), '') as address from pages)\n"


def _page_messages(spark, sf_dir):
    configure(spark)
    address = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\\"), F.lit("")), F.lit('"'), F.lit(""))
    return fx.table(spark, sf_dir, "pages").select("page_id", address.alias("address")).select("page_id", _PAGE_MESSAGE().alias("doc"))


@query(
    "explode_order",
    _PAGES_SQL
    + """select page_id, cast(0 as integer) as place, '{"n":' || page_id || ',"a":[' || page_id || ',{"y":"' || address || '","it''s":' || page_id || '}]}' as message from p
union all select page_id, 1, '{"q":true,"c":null}' from p
union all select page_id, 2, '"' || address || '"' from p""",
)
def explode_order(spark, sf_dir):
    """``.[]`` with the place of each output; values come in the order of the document and keep their keys' order."""
    return run_program(_page_messages(spark, sf_dir), Program(Each(".")), keep=("page_id",), input_json="doc", position="place")


@query(
    "reshape_order",
    _PAGES_SQL
    + """select page_id, '{"whole":' || """ + _PAGE_MESSAGE_SQL + """ || ',"deep":{"y":"' || address || '","it''s":' || page_id || '},"none":null}' as message from p""",
)
def reshape_order(spark, sf_dir):
    """Nested objects inside a new one, as the document has them; a key with a quote among them."""
    prog = Program(Reshape({"whole": ".", "deep": ".z.a[1]", "none": ".z.none"}))
    return run_program(_page_messages(spark, sf_dir), prog, keep=("page_id",), input_json="doc")


@query("project_quoted_key", _PAGES_SQL + "select page_id, cast(page_id as varchar) as message from p")
def project_quoted_key(spark, sf_dir):
    """P5: a key that holds a quote, below an array."""
    return run_program(_page_messages(spark, sf_dir), Program(Project(""".z.a[1]["it's"]""")), keep=("page_id",), input_json="doc")


@query(
    "where_path",
    with_(FRAMES)
    + f"""select source, sequence, {json_line('source', 'sequence', 'received_at_ms', 'kind', 'encoding', 'payload_text')} as message
from frames where json_extract_string(payload_text, '$.data.decoded.header.payloadTypeName') = 'click'""",
)
def where_path(spark, sf_dir):
    """``select(.payload.data.decoded.header.payloadTypeName == "click")``."""
    prog = Program(Select(".payload.data.decoded.header.payloadTypeName", "==", "click"))
    return run_program(_program_input(spark, sf_dir), prog)


@query(
    "raw_source",
    with_(FRAMES) + "select source, sequence, kind, md5(encode(payload_text)) as payload_md5 from frames where source = 'src-2'",
)
def raw_source(spark, sf_dir):
    """One source's frames as received (kind, payload)."""
    f = _events(spark, sf_dir, decode=False)
    r = raw_source_op(f, "src-2", fx.source_catalog(spark, sf_dir))
    return r.select("source", "sequence", "kind", F.md5("payload").alias("payload_md5"))


_FULL_SQL = with_(FRAMES) + """
, s as (select * from frames where source in ('src-1','src-2','src-4') and payload_type in ('CLICK','VIEW'))
, g as (select *, received_at_ms // 3600000 as gen,
               row_number() over (partition by content_hash, received_at_ms // 3600000
                                  order by received_at_ms, source, sequence) as rn
        from s where content_hash is not null)
, f as (select * from g where rn = 1)
, l as (select *, lag(gen) over (partition by content_hash order by gen) as pgen from f)
, r as (select *, max(case when pgen is null or gen - pgen > 1 then gen end)
                  over (partition by content_hash order by gen rows between unbounded preceding and current row) as run_start
        from l)
, kept as (select * from r where (gen - run_start) % 2 = 0)
select source, sequence,
       '{"hash":' || to_json(content_hash) || ',"seq":' || sequence || '}' as message
from kept where json_extract(payload_text, '$.data.id')::bigint >= 100
"""


@query("subscribe_full", _FULL_SQL)
def subscribe_full(spark, sf_dir):
    """sources, types, dedup (W asked 7200 s, clamped to 3600 s), program."""
    prog = Program(Select(".payload.data.id", ">=", 100), Reshape({"hash": ".payload.data.hash", "seq": ".sequence"}))
    sub = Subscription(sources=("src-1",), sources_csv="src-2, src-4,src-1", payload_types="click,view",
                       dedup_by_content=True, dedup_window_s=7200, program=prog)
    f = _events(spark, sf_dir, columns=["source", "sequence", "received_at_ms", "kind", "encoding", "payload_text",
                                        "payload_v", "payload_type", "content_hash"])
    return subscribe(f, sub, fx.source_catalog(spark, sf_dir), dedup_mode="aligned")


@query(
    "subscribe_binary",
    with_(FRAMES)
    + f"""select source, sequence,
       md5({envelope('source', 'sequence', 'received_at_ms', 'kind', 'encode(payload_text)')}) as envelope_md5
from frames where source = 'src-3'""",
)
def subscribe_binary(spark, sf_dir):
    """Binary subscribers get the envelope bytes."""
    f = _events(spark, sf_dir, decode=False)
    out = subscribe(f, Subscription(sources_csv="src-3", binary=True))
    return out.select("source", "sequence", F.md5("envelope").alias("envelope_md5"))


def _arg_rows(ev):
    """Argument text per event: a flag spelling, a requested window, a source list."""
    k = F.col("event_id") % 8
    flag = (
        F.when(k == 0, F.lit("")).when(k == 1, F.lit(" 1")).when(k == 2, F.lit("TRUE")).when(k == 3, F.lit(" yes "))
        .when(k == 4, F.lit("On")).when(k == 5, F.lit("no")).when(k == 6, F.lit("0"))
    )
    req = F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("event_id") % 5000 - 10)
    csv = F.concat(F.col("event_type"), F.lit(", src-"), (F.col("user_id") % 8).cast("string"), F.lit(",, "),
                   F.col("event_type"), F.lit(" ,src-"), (F.col("user_id") % 3).cast("string"))
    return ev.select("event_id", flag.alias("flag_text"), req.alias("requested"), csv.alias("csv"))


@query(
    "flag_and_window_args",
    """with a as (
  select event_id,
         case event_id % 8 when 0 then '' when 1 then ' 1' when 2 then 'TRUE' when 3 then ' yes '
              when 4 then 'On' when 5 then 'no' when 6 then '0' end as flag_text,
         case when event_id % 3 = 0 then null else event_id % 5000 - 10 end as requested,
         event_type || ', src-' || (user_id % 8) || ',, ' || event_type || ' ,src-' || (user_id % 3) as csv
  from events)
, b as (select *, coalesce(lower(trim(flag_text)) in ('', '1', 'true', 'yes', 'on'), false) as flag,
               list_filter(list_transform(string_split(csv, ','), lambda x: trim(x)), lambda x: x <> '') as parts
        from a)
select event_id, flag,
       case when flag then (case when requested is null then 300 else least(greatest(requested, 1), 3600) end) end as window_s,
       array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), '|') as sources
from b""",
)
def flag_and_window_args(spark, sf_dir):
    """Flag spellings, effective dedup window, source lists."""
    configure(spark)
    a = _arg_rows(fx.table(spark, sf_dir, "events"))
    flag = sc.parse_flag("flag_text")
    return a.select(
        "event_id",
        flag.alias("flag"),
        sc.effective_window(F.col("requested"), F.lit(300), F.lit(3600), flag).alias("window_s"),
        F.array_join(sc.parse_csv_list("csv"), "|").alias("sources"),
    )


@query(
    "union_sources",
    with_(FRAMES, DOC_FRAMES, PAGE_FRAMES)
    + """select source, kind, count(*) as frames, cast(sum(payload_bytes) as bigint) as bytes from (
  select 'events' as source, kind, payload_bytes from frames
  union all select 'documents', kind, payload_bytes from doc_frames
  union all select 'pages', kind, payload_bytes from page_frames) t group by 1, 2""",
)
def union_sources(spark, sf_dir):
    """Three upstreams (JSON text, plain text, binary) as one frame stream."""
    configure(spark)
    ev = fx.table(spark, sf_dir, "events").select(
        F.lit("events").alias("source"), sc.kind_of(F.lit(True)).alias("kind"), fx.event_payload().cast("binary").alias("payload"))
    docs = fx.table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source"), sc.kind_of(F.lit(True)).alias("kind"), F.col("text").cast("binary").alias("payload"))
    pages = fx.table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source"), sc.kind_of(F.lit(False)).alias("kind"), F.col("html").cast("binary").alias("payload"))
    u = union_frames(ev, docs, pages)
    return u.groupBy("source", "kind").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(sc.payload_bytes("payload")).alias("bytes"))


_REPLAY_SQL = with_(FRAMES).replace("with ", "with recursive ", 1) + """
, s as (select * from frames where source in ('src-1','src-2','src-4') and payload_type in ('CLICK','VIEW'))
, arr as (select distinct received_at_ms as ms from s where content_hash is not null)
, rot(r, k) as (
    select min(ms), 0 from arr
    union all
    select (select min(ms) from arr where arr.ms >= rot.r + 1800000), k + 1 from rot where r is not null)
, rots as (select r, k from rot where r is not null)
, gens as (select arr.ms, rots.k as gen from arr asof join rots on arr.ms >= rots.r)
, g as (select s.*, gens.gen,
               row_number() over (partition by content_hash, gens.gen order by received_at_ms, source, sequence) as rn
        from s join gens on s.received_at_ms = gens.ms where content_hash is not null)
, f as (select * from g where rn = 1)
, l as (select *, lag(gen) over (partition by content_hash order by gen) as pgen from f)
, r as (select *, max(case when pgen is null or gen - pgen > 1 then gen end)
                  over (partition by content_hash order by gen rows between unbounded preceding and current row) as run_start
        from l)
, kept as (select * from r where (gen - run_start) % 2 = 0)
select source, sequence, '{"hash":' || to_json(content_hash) || ',"seq":' || sequence || '}' as message
from kept where json_extract(payload_text, '$.data.id')::bigint >= 100
"""


@query("subscribe_replay", _REPLAY_SQL)
def subscribe_replay(spark, sf_dir):
    """F5 with the relay's dedup (D1): rotation driven by the frames that passed the
    source and type filters, from the first of them; W = 1800 s."""
    prog = Program(Select(".payload.data.id", ">=", 100), Reshape({"hash": ".payload.data.hash", "seq": ".sequence"}))
    sub = Subscription(sources_csv="src-1,src-2,src-4", payload_types="CLICK,view", dedup_by_content=True,
                       dedup_window_s=1800, program=prog)
    f = _events(spark, sf_dir, columns=["source", "sequence", "received_at_ms", "kind", "encoding", "payload_text",
                                        "payload_v", "payload_type", "content_hash"])
    return subscribe(f, sub, fx.source_catalog(spark, sf_dir), dedup_mode="replay")
