"""DuckDB SQL building blocks for the oracle (same derivations as meshframes.fixtures).

Epoch milliseconds are ``epoch_us(ts)//1000`` (floored like Spark's ``unix_millis``).
"""

MS = "(epoch_us(ts)//1000)"

EVENT_PAYLOAD = (
    "'{\"type\":\"packet\",\"data\":{\"id\":'||event_id||',\"hash\":\"'||event_type||'-'||(user_id % 10)"
    "||'\",\"decoded\":{\"header\":{\"payloadTypeName\":\"'||event_type||'\"}}}}'"
)


def meta_ok(p: str) -> str:
    """Strict probe: document is valid JSON, data an object, inner levels objects or
    null, leaves strings or null."""
    return (
        f"(json_valid({p}) and json_type({p}) = 'OBJECT' and json_type({p}, '$.data') = 'OBJECT'"
        f" and coalesce(json_type({p}, '$.data.hash') in ('VARCHAR','NULL'), true)"
        f" and coalesce(json_type({p}, '$.data.decoded') in ('OBJECT','NULL'), true)"
        f" and coalesce(json_type({p}, '$.data.decoded.header') in ('OBJECT','NULL'), true)"
        f" and coalesce(json_type({p}, '$.data.decoded.header.payloadTypeName') in ('VARCHAR','NULL'), true))"
    )


def payload_type(p: str) -> str:
    return f"(case when {meta_ok(p)} then upper(json_extract_string({p}, '$.data.decoded.header.payloadTypeName')) end)"


def content_hash(p: str) -> str:
    return f"(case when {meta_ok(p)} then nullif(json_extract_string({p}, '$.data.hash'), '') end)"


# Frames from events, decoded (all payloads are JSON packets).
FRAMES = f"""frames as (
  select source, sequence, received_at_ms, event_id, cast(1 as tinyint) as kind, payload_text,
         cast(strlen(payload_text) as bigint) as payload_bytes, 'json' as encoding,
         {payload_type('payload_text')} as payload_type, {content_hash('payload_text')} as content_hash
  from (select 'src-'||(user_id % 8) as source,
               row_number() over (partition by user_id % 8 order by ts, event_id) - 1 as sequence,
               {MS} as received_at_ms, event_id, {EVENT_PAYLOAD} as payload_text
        from events) r)"""

COUNTERS = f"""counters as (
  select source, at_ms,
         cast(sum(p) over (partition by source, seg order by at_ms) as bigint) as packets,
         cast(sum(b) over (partition by source, seg order by at_ms) as bigint) as bytes
  from (select 'src-'||(user_id % 8) as source,
               cast(floor({MS}/3600000) as bigint)*3600000 as at_ms,
               cast(floor({MS}/864000000) as bigint) as seg,
               count(*) as p, sum(length(props)) as b
        from events group by 1,2,3) t)"""

CONN_EVENTS = f"""conn_events as (
  select 'src-'||(user_id % 8) as source, {MS} as at_ms,
         case event_type when 'error' then 'reconnect_wait' when 'signup' then 'connecting'
              when 'purchase' then 'disconnected' else 'connected' end as state,
         case when event_type='error' then 'upstream error' end as error,
         event_id as seq
  from events)"""

SUBSCRIPTION_EVENTS = f"""subscription_events as (
  select 'sub-'||user_id as subscription_id, {MS} as at_ms,
         row_number() over (partition by user_id order by ts, event_id) % 2 = 1 as opened,
         case when user_id % 3 = 0 then null else 'src-'||(user_id % 8) end as source,
         event_id
  from events)"""

PROCESS_SAMPLES = f"""process_samples as (
  select 'i-'||(user_id % 2) as instance, {MS} as at_ms, event_id,
         cast(sum(value::decimal(18,2)) over (partition by user_id % 2 order by ts, event_id rows between unbounded preceding and current row) as double) as cpu_seconds,
         event_id*1000 as rss_bytes, cast(64 as bigint) as open_fds, cast(1024 as bigint) as max_fds,
         1704067200.0::double as start_time_s
  from events)"""

NETWORKS = """networks as (
  select 'net-'||(page_id % 5) as network, page_id % 5 as npos, page_id as apos,
         case when page_id % 11 = 0 then replace(replace(url,'https:','ftp:'),'http:','ftp:')
              when page_id % 4 = 0 then url||'/ws/' else url end as url
  from pages
  union all
  select 'net-'||((page_id + 1) % 5), (page_id + 1) % 5, page_id + 100000, url
  from pages where page_id % 9 = 0)"""

RESTARTED = f"""restarted as (
  select * from (
    select 'src-'||(user_id % 8) as source, {MS} as received_at_ms, event_id,
           row_number() over (partition by user_id % 8, cast(floor({MS}/864000000) as bigint) order by {MS}, event_id) - 1 as sequence
    from events) r where (event_id * 7) % 5 <> 2)"""

CONV_GAPS = """conv_frames as (
  select 'conv-'||conv_id as source, turn as sequence
  from conversations where (conv_id*7+turn) % 5 <> 2)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def be(n: str, width: int) -> str:
    """Big-endian fixed-width bytes of a non-negative integer expression."""
    return f"unhex(lpad(hex({n}), {2 * width}, '0'))"


def envelope(source: str, sequence: str, ms: str, kind: str, payload_blob: str, source_blob: str | None = None) -> str:
    src = source_blob or f"encode({source})"
    return (
        f"('CSR1'::BLOB || {be(kind, 1)} || {be(f'octet_length({src})', 2)} || {be(sequence, 8)} || {be(ms, 8)}"
        f" || {be(f'octet_length({payload_blob})', 4)} || {src} || {payload_blob})"
    )


def json_line(source: str, sequence: str, ms: str, kind: str, encoding: str, payload_text: str) -> str:
    return (
        f"('{{\"source\":' || to_json({source}) || ',\"sequence\":' || {sequence} || ',\"timestamp_ms\":' || {ms}"
        f" || ',\"kind\":' || {kind} || ',\"encoding\":' || to_json({encoding}) || ',\"payload\":' ||"
        f" (case when {encoding} = 'json' then {payload_text} else to_json({payload_text}) end) || '}}')"
    )


# Document and page frames as the Spark fixtures build them.
DOC_FRAMES = """doc_frames as (
  select source, doc_id as sequence, doc_id as received_at_ms, cast(1 as tinyint) as kind, text as payload_text,
         cast(strlen(text) as bigint) as payload_bytes,
         case when json_valid(text) then 'json' else 'utf8' end as encoding
  from documents)"""

PAGE_FRAMES = """page_frames as (
  select 'pages' as source, page_id as sequence, page_id as received_at_ms, cast(2 as tinyint) as kind,
         base64(encode(html)) as payload_text, cast(strlen(html) as bigint) as payload_bytes, 'base64' as encoding
  from pages)"""


_URL_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def websocket_url(u: str) -> str:
    """DuckDB form of the analyzer URL normalisation (null = rejected)."""
    re_ = _URL_RE
    scheme = f"lower(regexp_extract({u}, '{re_}', 1))"
    authority = f"regexp_extract({u}, '{re_}', 3)"
    path0 = f"regexp_extract({u}, '{re_}', 4)"
    query = f"regexp_extract({u}, '{re_}', 5)"
    new_scheme = (f"(case {scheme} when 'https' then 'wss' when 'http' then 'ws' when 'ws' then 'ws' "
                  f"when 'wss' then 'wss' end)")
    userinfo = f"regexp_extract({authority}, '^(.*@)?', 1)"
    hostport = f"regexp_replace({authority}, '^.*@', '')"
    host = f"lower(regexp_extract({hostport}, '^(\\[[^\\]]*\\]|[^:]*)', 1))"
    port0 = f"regexp_extract({hostport}, '^(?:\\[[^\\]]*\\]|[^:]*)(:\\d*)?$', 1)"
    dport = f"(case when {new_scheme} = 'wss' then ':443' else ':80' end)"
    port = f"(case when {port0} = {dport} or {port0} = ':' then '' else {port0} end)"
    path = f"(case when {path0} = '' then '/' else {path0} end)"
    cut = f"regexp_replace({path}, '/+$', '')"
    new_path = f"(case when suffix({cut}, '/ws') then {path} else {cut} || '/ws' end)"
    out = f"({new_scheme} || '://' || {userinfo} || {host} || {port} || {new_path} || {query})"
    return f"(case when regexp_matches({u}, '{re_}') and {new_scheme} is not null and {host} <> '' then {out} end)"
