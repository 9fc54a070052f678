"""Source catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshframes import fixtures as fx
from meshframes.functions import scalars as sc
from meshframes.operators import catalog as cg
from meshframes.operators import filters as flt
from meshframes.operators import health as hl
from meshframes.plans.health_queries import AT_MS, CATALOG_SQL, STATES_SQL, _catalog
from meshframes.plans.registry import query
from meshframes.plans.sql import CONN_EVENTS, FRAMES, NETWORKS, websocket_url, with_
from meshframes.schema import DedupPolicy, RelaySettings
from meshframes.session import configure, scratch_path


@query(
    "source_catalog",
    with_(NETWORKS)
    + f"""
, n as (select *, {websocket_url('url')} as ws_url from networks)
, f as (select *, row_number() over (partition by ws_url order by npos, apos) as rn from n where ws_url is not null)
, k as (select *, row_number() over (partition by npos order by apos) as num from f where rn = 1)
select case when num = 1 then network else network || '-' || num end as id, ws_url as url,
       network || ':' || (num - 1) as mapping, network, npos, apos from k""",
)
def source_catalog(spark, sf_dir):
    """C1 P13 (S9): network directory to source catalog."""
    configure(spark)
    c = cg.build_source_catalog(fx.networks_flat(spark, sf_dir))
    return c.select("id", "url", "mapping", "network", "npos", "apos")


@query(
    "rejected_analyzers",
    with_(NETWORKS) + f"select network, npos, apos, url from networks where {websocket_url('url')} is null",
)
def rejected_analyzers(spark, sf_dir):
    """Analyzers whose URL scheme is not http(s)/ws(s) are skipped and reported."""
    configure(spark)
    _, rejected = cg.build_source_catalog(fx.networks_flat(spark, sf_dir), with_rejected=True)
    return rejected


#: Ways of writing an address that mean the same, or nothing: what is put before the host, and after it with path ``/a/b``.
_WRITTEN = [
    ("  https://", "/a/b ", "wss://", "/a/b/ws"), ("HTTP:", ":080/./a/c/../b", "ws://", "/a/b/ws"), ("https:////", ":443/a/b/ws//#top", "wss://", "/a/b/ws//"),
    ("wss:\\\\", "\\a\\%2E%2e\\a\\b", "wss://", "/a/b/ws"), ("ws://", ":70000/a/b", None, None), ("http://me:pass word@", ":8080?x='1 2'", "ws://me:pass%20word@", ":8080/ws?x=%271%202%27"),
    ("ftp://", "/a/b", None, None), ("https://@", "/a/b/..", "wss://", "/a/ws"), ("https://no good.", "/", None, None), ("//", "/a/b", None, None),
    ("https://", "/é{b}?", "wss://", "/%C3%A9%7Bb%7D/ws?"),
]


def _quoted(text) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


@query(
    "websocket_urls",
    "with w(k, ahead, front, back) as (values "
    + ", ".join(f"({k}, {_quoted(before + '|' + after)}, {_quoted(front)}, {_quoted(back)})" for k, (before, after, front, back) in enumerate(_WRITTEN))
    + f""")
select page_id, replace(ahead, '|', 'H' || page_id || '.Example') as url, front || 'h' || page_id || '.example' || back as ws_url
from pages join w on w.k = page_id % {len(_WRITTEN)}""",
)
def websocket_urls(spark, sf_dir):
    """One host a page, its address written in ways that the URL Standard reads alike or rejects."""
    configure(spark)
    spelled = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b, a, _, _ in _WRITTEN])
    way = F.get(spelled, (F.col("page_id") % len(_WRITTEN)).cast("int"))
    pages = fx.table(spark, sf_dir, "pages").select("page_id", F.concat(way["b"], F.lit("H"), F.col("page_id").cast("string"), F.lit(".Example"), way["a"]).alias("url"))
    return pages.select("page_id", "url", sc.websocket_url("url").alias("ws_url"))


@query(
    "read_sources",
    with_(NETWORKS)
    + """select network || '/' || apos as id, url, apos % 3 = 0 as disabled, case when apos % 4 = 1 then 'http://proxy:8888' end as proxy,
       case when apos % 2 = 0 then 'm' || apos end as mapping, case when apos % 5 = 0 then '{"x-key":"' || apos || '"}' else '{}' end as headers from networks""",
)
def read_sources(spark, sf_dir):
    """A catalog written as JSON lines with fields left out, and read with its schema and defaults."""
    configure(spark)
    n = fx.networks_flat(spark, sf_dir)
    apos = F.col("apos")
    path = scratch_path(spark, "sources-json")
    n.select(
        F.concat("network", F.lit("/"), apos.cast("string")).alias("id"), "url",
        F.when(apos % 5 == 0, F.create_map(F.lit("x-key"), apos.cast("string"))).alias("headers"), F.when(apos % 3 == 0, F.lit(True)).alias("disabled"),
        F.when(apos % 4 == 1, F.lit("http://proxy:8888")).alias("proxy"), F.when(apos % 2 == 0, F.concat(F.lit("m"), apos.cast("string"))).alias("mapping"),
    ).write.option("ignoreNullFields", "true").json(path)
    return cg.read_sources(spark, path).select("id", "url", "disabled", "proxy", "mapping", F.to_json("headers").alias("headers"))


_VIOL_CAT = """cat as (
  select case when page_id % 97 = 0 then '' when page_id % 101 = 0 then repeat('x', 65536) || (page_id % 2)
              else 'p-' || (page_id % 40) end as id,
         case page_id % 13 when 0 then '' when 1 then 'socks5://h:1' when 2 then 'http://' when 3 then 'http://proxy:8888'
              when 4 then '   ' when 5 then chr(9) || chr(160) end as proxy
  from pages)"""


@query(
    "catalog_violations",
    with_(_VIOL_CAT)
    + r"""
, pol as (select cast(null as varchar) as id, 'user_agent_newline' as rule, 'settings' as detail
          union all select null, 'dedup_max_window', 'settings')
, dup as (select id, 'duplicate_id' as rule, count(*)::varchar || ' rows' as detail from cat group by id having count(*) > 1)
, idr as (select id,
                 case when id = '' then 'empty_id' else 'id_too_long' end as rule, strlen(id)::varchar as detail
          from cat where id = '' or strlen(id) > 65535)
, px as (select id, lower(regexp_extract(proxy, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) as scheme,
                regexp_extract(proxy, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1) as host, proxy
         from cat where proxy is not null)
, pxr as (select id, case when trim(proxy, ' ' || chr(9) || chr(160)) = '' then 'empty_proxy' when scheme = '' then 'invalid_proxy'
                          when scheme <> 'http' then 'proxy_not_http' when host = '' then 'proxy_without_host' end as rule,
                 'proxy' as detail from px)
select * from pol union all select * from dup union all select * from idr
union all select * from pxr where rule is not null""",
)
def catalog_violations(spark, sf_dir):
    """All catalog and settings violations, one row each."""
    configure(spark)
    p = fx.table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    cat = p.select(
        F.when(pid % 97 == 0, F.lit("")).when(pid % 101 == 0, F.concat(F.repeat(F.lit("x"), 65536), (pid % 2).cast("string")))
        .otherwise(F.concat(F.lit("p-"), (pid % 40).cast("string"))).alias("id"),
        F.when(pid % 13 == 0, F.lit("")).when(pid % 13 == 1, F.lit("socks5://h:1")).when(pid % 13 == 2, F.lit("http://"))
        .when(pid % 13 == 3, F.lit("http://proxy:8888")).when(pid % 13 == 4, F.lit("   "))
        .when(pid % 13 == 5, F.lit("\t\u00a0")).alias("proxy"),
    )
    settings = RelaySettings(user_agent="relay\nbot", dedup=DedupPolicy(default_window_s=600, max_window_s=300))
    return cg.validate_sources(cat, settings)


def _diff_side(p, new: bool):
    pid = F.col("page_id")
    auth = lambda v: F.create_map(F.lit("Authorization"), v)
    base_h = F.when(pid % 3 == 0, auth(F.concat(F.lit("Bearer "), (pid % 7).cast("string"))))
    if not new:
        return p.select(
            F.concat(F.lit("p-"), pid.cast("string")).alias("id"), "url", base_h.alias("headers"),
            (pid % 10 == 0).alias("disabled"),
            F.when(pid % 11 == 0, F.lit("http://proxy:8888")).alias("proxy"),
            F.concat(F.lit("m"), (pid % 4).cast("string")).alias("mapping"),
        )
    kept = p.filter(pid % 17 != 0).select(
        F.concat(F.lit("p-"), pid.cast("string")).alias("id"),
        F.when(pid % 5 == 1, F.concat(F.col("url"), F.lit("?v=2"))).otherwise(F.col("url")).alias("url"),
        F.when(pid % 6 == 3, auth(F.lit("Bearer x"))).otherwise(base_h).alias("headers"),
        (pid % 10 == 1).alias("disabled"),
        F.when(pid % 11 == 0, F.lit("http://proxy:8888")).alias("proxy"),
        F.when(pid % 4 == 2, F.lit("m9")).otherwise(F.concat(F.lit("m"), (pid % 4).cast("string"))).alias("mapping"),
    )
    added = p.filter(pid % 19 == 0).select(
        F.concat(F.lit("p-new-"), pid.cast("string")).alias("id"), "url", F.lit(None).cast("map<string,string>").alias("headers"),
        F.lit(False).alias("disabled"), F.lit(None).cast("string").alias("proxy"), F.lit(None).cast("string").alias("mapping"),
    )
    return kept.unionByName(added)


@query(
    "catalog_diff",
    """with o as (
  select 'p-' || page_id as id, url, case when page_id % 3 = 0 then 'Bearer ' || (page_id % 7) end as hv,
         page_id % 10 = 0 as disabled, case when page_id % 11 = 0 then 'http://proxy:8888' end as proxy,
         'm' || (page_id % 4) as mapping
  from pages)
, n as (
  select 'p-' || page_id as id, case when page_id % 5 = 1 then url || '?v=2' else url end as url,
         case when page_id % 6 = 3 then 'Bearer x' when page_id % 3 = 0 then 'Bearer ' || (page_id % 7) end as hv,
         page_id % 10 = 1 as disabled, case when page_id % 11 = 0 then 'http://proxy:8888' end as proxy,
         case when page_id % 4 = 2 then 'm9' else 'm' || (page_id % 4) end as mapping
  from pages where page_id % 17 <> 0
  union all
  select 'p-new-' || page_id, url, null, false, null, null from pages where page_id % 19 = 0)
select coalesce(o.id, n.id) as id,
       case when o.id is null then 'added' when n.id is null then 'removed' when n.disabled and not o.disabled then 'stopped' when n.disabled then 'unchanged'
            when not o.disabled and (o.url is distinct from n.url or o.hv is distinct from n.hv
                                     or o.proxy is distinct from n.proxy) then 'restarted'
            when o.disabled then 'started' else 'unchanged' end as change,
       o.id is not null and n.id is not null and o.mapping is distinct from n.mapping as mapping_changed
from o full outer join n on o.id = n.id""",
)
def catalog_diff(spark, sf_dir):
    """Added / removed / stopped / restarted / started / unchanged per id."""
    configure(spark)
    p = fx.table(spark, sf_dir, "pages").select("page_id", "url")
    return cg.diff_sources(_diff_side(p, False), _diff_side(p, True))


@query(
    "list_sources",
    with_(CONN_EVENTS, CATALOG_SQL) + STATES_SQL
    + "select c.id, c.url, c.mapping, s.state from catalog c join states s on c.id = s.source",
)
def list_sources(spark, sf_dir):
    """Id, url, mapping and state per source, ordered by id; no headers or proxy."""
    configure(spark)
    cat = cg.with_source_defaults(_catalog(spark, sf_dir).drop("disabled"))
    st = hl.state_asof(fx.conn_events_from_events(spark, sf_dir), AT_MS, cat)
    return cg.list_sources(cat, st)


@query(
    "enabled_frames",
    with_(FRAMES, CATALOG_SQL)
    + """select source, count(*) as packets from frames
where source in (select id from catalog where not disabled) group by 1""",
)
def enabled_frames(spark, sf_dir):
    """disabled sources stay listed but yield no frames."""
    configure(spark)
    f = fx.frames_from_events(spark, sf_dir, decode=False)
    kept = flt.drop_disabled(f, _catalog(spark, sf_dir))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("packets"))
