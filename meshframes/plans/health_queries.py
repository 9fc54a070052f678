"""Queries over connection changes, frames and rates (H, A4, A7, P8, P14, S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshframes import fixtures as fx
from meshframes.functions import scalars as sc
from meshframes.operators import aggregates as agg
from meshframes.operators import health as hl
from meshframes.operators import windows as win
from meshframes.plans.registry import query
from meshframes.plans.sql import CONN_EVENTS, COUNTERS, FRAMES, PROCESS_SAMPLES, SUBSCRIPTION_EVENTS, with_
from meshframes.plans.telemetry_queries import _RATES_SQL
from meshframes.session import configure
from meshframes.sources.output import latest_message, telemetry_messages

# As-of time for point-in-time health: 2024-01-16T00:00:00Z.
AT_MS = 1705363200000

CATALOG_SQL = """catalog as (
  select distinct 'src-'||(user_id % 9) as id, 'wss://src-'||(user_id % 9)||'.example/ws' as url,
         'events:'||(user_id % 9) as mapping, (user_id % 9) in (3, 8) as disabled from events)"""

_STATE_CODE = ("case {s} when 'disabled' then 0 when 'disconnected' then 1 when 'connecting' then 2 "
               "when 'handshaking' then 3 when 'connected' then 4 when 'reconnect_wait' then 5 "
               "when 'reconnect_wait_degraded' then 6 when 'stopping' then 7 end")
_LABEL = "case {s} when 'reconnect_wait' then 'retrying' when 'reconnect_wait_degraded' then 'degraded' else {s} end"

STATES_SQL = f"""
, last_state as (select source, state, at_ms from (
    select *, row_number() over (partition by source order by at_ms desc, seq desc) as rn
    from conn_events where at_ms <= {AT_MS}) x where rn = 1)
, states as (select c.id as source, coalesce(l.state, 'disconnected') as state, l.at_ms as since_ms
             from catalog c left join last_state l on c.id = l.source)
, e as (select * from conn_events where at_ms <= {AT_MS})
, off as (select source, at_ms as oat, seq as oseq from (
    select *, row_number() over (partition by source order by at_ms desc, seq desc) as rn
    from e where state <> 'connected') x where rn = 1)
, con as (select e.source, min(e.at_ms) as since from e left join off on e.source = off.source
          where e.state = 'connected' and (off.oat is null or e.at_ms > off.oat or (e.at_ms = off.oat and e.seq > off.oseq))
          group by 1)
, csecs as (select s.source, case when s.state = 'connected' then cast(floor(greatest({AT_MS} - con.since, 0) / 1000) as bigint) end as connected_secs
            from states s left join con on s.source = con.source)
"""

AGES_SQL = f"""
, lastp as (select source, max(received_at_ms) as last_packet_ms from frames where received_at_ms <= {AT_MS} group by 1)
, ages as (select c.id as source, l.last_packet_ms, cast(floor(({AT_MS} - l.last_packet_ms) / 1000) as bigint) as last_packet_secs_ago
           from catalog c left join lastp l on c.id = l.source)
, ages2 as (select *, case when last_packet_secs_ago >= 300 then 'bad' when last_packet_secs_ago >= 60 then 'warn'
                           when last_packet_secs_ago is not null then 'ok' end as idle_level from ages)
"""


_catalog = fx.source_catalog


def _conn(spark, sf_dir):
    configure(spark)
    return fx.conn_events_from_events(spark, sf_dir)


@query(
    "state_asof",
    with_(CONN_EVENTS, CATALOG_SQL) + STATES_SQL
    + f"""select s.source, s.state, cast({_STATE_CODE.format(s='s.state')} as tinyint) as state_code, s.since_ms,
       {_LABEL.format(s='s.state')} as label, s.state = 'connected' as live, c.connected_secs
from states s join csecs c on s.source = c.source""",
)
def state_asof(spark, sf_dir):
    """State, code, label and connected seconds per catalog source at a time."""
    ce = _conn(spark, sf_dir)
    cat = _catalog(spark, sf_dir)
    st = hl.state_asof(ce, AT_MS, cat)
    cs = hl.connected_seconds(ce, AT_MS, cat)
    return st.join(cs, "source").select(
        "source", "state", "state_code", "since_ms", sc.state_label("state").alias("label"),
        sc.is_live("state").alias("live"), "connected_secs",
    )


@query(
    "connected_counts",
    with_(CONN_EVENTS, CATALOG_SQL) + STATES_SQL
    + "select count_if(state = 'connected') as connected, count(*) as total from states",
)
def connected_counts(spark, sf_dir):
    """A4: connected sources over all catalog sources."""
    st = hl.state_asof(_conn(spark, sf_dir), AT_MS, _catalog(spark, sf_dir))
    return agg.connected_counts(st)


@query(
    "error_totals",
    with_(CONN_EVENTS)
    + """select source, count_if(error is not null) as errors,
       count_if(state in ('reconnect_wait', 'reconnect_wait_degraded')) as reconnects from conn_events group by 1""",
)
def error_totals(spark, sf_dir):
    """Errors and reconnect waits per source."""
    return agg.error_totals(_conn(spark, sf_dir))


@query(
    "episodes",
    with_(CONN_EVENTS)
    + """
, c as (select *, case when state = 'connected' then 'connected' else 'offline' end as cls from conn_events)
, l as (select *, lag(cls) over (partition by source order by at_ms, seq) as pcls from c)
, s as (select *, sum(case when pcls is null or pcls <> cls then 1 else 0 end)
                  over (partition by source order by at_ms, seq rows between unbounded preceding and current row) as spell from l)
, sp as (select source, spell, min(cls) as kind, min(at_ms) as start_ms, count(*) as changes from s group by 1, 2)
select sp.source, cast(sp.spell as bigint) as spell, sp.kind, sp.start_ms, n.start_ms as end_ms,
       cast(floor((n.start_ms - sp.start_ms) / 1000) as bigint) as seconds, sp.changes
from sp left join sp n on n.source = sp.source and n.spell = sp.spell + 1""",
)
def episodes(spark, sf_dir):
    """H5: connected / offline spells per source."""
    return hl.episodes(_conn(spark, sf_dir))


@query(
    "retry_waits",
    with_(CONN_EVENTS)
    + """
, g as (select *, sum(case when state = 'connected' then 1 else 0 end)
                  over (partition by source order by at_ms, seq rows between unbounded preceding and current row) as grp
        from conn_events)
, o as (select source, grp, min(at_ms) as off_since from g
        where state <> 'connected' and (grp > 0 or state in ('reconnect_wait', 'reconnect_wait_degraded')) group by 1, 2)
, d as (select g.*, coalesce(g.at_ms - o.off_since >= 60000, false) as deg
        from g left join o on g.source = o.source and g.grp = o.grp)
, k as (select *, sum(case when state in ('reconnect_wait', 'reconnect_wait_degraded') and not deg then 1 else 0 end)
                  over (partition by source, grp order by at_ms, seq rows between unbounded preceding and current row) as kk
        from d)
select source, at_ms, seq, case when deg then 'degraded' else 'normal' end as kind,
       case when deg then null else cast(kk - 1 as bigint) end as attempt,
       case when deg then 300.0 else least(1.0 * pow(2.0, kk - 1), 30.0) end as wait_s
from k where state in ('reconnect_wait', 'reconnect_wait_degraded')""",
)
def retry_waits(spark, sf_dir):
    """H6: every retry with kind (normal / degraded), attempt and wait due."""
    return hl.retry_waits(_conn(spark, sf_dir))


def _frames(spark, sf_dir):
    configure(spark)
    return fx.frames_from_events(spark, sf_dir, decode=False)


@query(
    "last_packet_age",
    with_(FRAMES, CATALOG_SQL) + AGES_SQL + "select source, last_packet_ms, last_packet_secs_ago, idle_level from ages2",
)
def last_packet_age(spark, sf_dir):
    """H3: seconds since the last packet per catalog source, with level."""
    return hl.last_packet_age(_frames(spark, sf_dir), AT_MS, _catalog(spark, sf_dir))


@query(
    "quiet_sources",
    with_(FRAMES, CONN_EVENTS, CATALOG_SQL) + STATES_SQL + AGES_SQL
    + """select s.source, s.state, a.last_packet_secs_ago, a.idle_level from states s left join ages2 a on s.source = a.source
where s.state = 'connected' and (a.last_packet_secs_ago is null or a.last_packet_secs_ago >= 60)""",
)
def quiet_sources(spark, sf_dir):
    """H4: connected sources without a packet for a minute."""
    cat = _catalog(spark, sf_dir)
    st = hl.state_asof(_conn(spark, sf_dir), AT_MS, cat)
    ages = hl.last_packet_age(_frames(spark, sf_dir), AT_MS, cat)
    return hl.quiet_sources(st, ages)


@query(
    "status_report",
    with_(FRAMES, CONN_EVENTS, COUNTERS, CATALOG_SQL) + STATES_SQL + AGES_SQL + _RATES_SQL
    + f"""
, lr as (select source, arg_max(packets_per_s, at_ms) as p, arg_max(bytes_per_s, at_ms) as b
         from rates where at_ms <= {AT_MS} group by 1)
select c.id, c.url, s.state, {_LABEL.format(s='s.state')} as label, s.state = 'connected' as live,
       round(coalesce(lr.p, 0.0), 6) as packets_per_s, round(coalesce(lr.b, 0.0), 6) as bytes_per_s,
       cs.connected_secs, a.last_packet_secs_ago, a.idle_level
from catalog c join states s on c.id = s.source join csecs cs on c.id = cs.source
     join ages2 a on c.id = a.source left join lr on c.id = lr.source""",
)
def status_report(spark, sf_dir):
    """One status row per catalog source, ordered by id."""
    configure(spark)
    rates = win.sample_rates(fx.counters_from_events(spark, sf_dir))
    r = hl.status_report(_catalog(spark, sf_dir), _conn(spark, sf_dir), _frames(spark, sf_dir), rates, AT_MS)
    return r.withColumn("packets_per_s", F.round("packets_per_s", 6)).withColumn("bytes_per_s", F.round("bytes_per_s", 6))


@query(
    "overall_status",
    with_(CONN_EVENTS, CATALOG_SQL) + STATES_SQL
    + """select count_if(state = 'connected') as connected, count(*) as total,
       case when count_if(state = 'connected') = count(*) and count(*) > 0 then 'ok'
            when count_if(state = 'connected') = 0 and count(*) > 0 then 'bad' else '' end as level
from states""",
)
def overall_status(spark, sf_dir):
    """H7 headline: connected/all and the ok / bad / blank level."""
    configure(spark)
    cat = _catalog(spark, sf_dir)
    st = hl.state_asof(_conn(spark, sf_dir), AT_MS, cat)
    return hl.overall_status(st)


@query(
    "status_table",
    with_(FRAMES, CONN_EVENTS, CATALOG_SQL) + STATES_SQL + AGES_SQL
    + """select coalesce(s.source, a.source) as source,
       case when s.state = 'connected' then 'up' when s.state is not null then 'down' end as status,
       a.last_packet_secs_ago as idle_s, a.idle_level
from states s full outer join ages2 a on s.source = a.source""",
)
def status_table(spark, sf_dir):
    """H8: up/down and idle seconds merged by source, down first."""
    cat = _catalog(spark, sf_dir)
    st = hl.state_asof(_conn(spark, sf_dir), AT_MS, cat)
    ages = hl.last_packet_age(_frames(spark, sf_dir), AT_MS, cat)
    return hl.status_table(st, ages)


_SNAPSHOT_SQL = (
    with_(FRAMES, CONN_EVENTS, COUNTERS, PROCESS_SAMPLES, SUBSCRIPTION_EVENTS, CATALOG_SQL)
    + _RATES_SQL
    + """
, before as (select *, lag(state) over (partition by source order by at_ms, seq) as was from conn_events)
, spells as (select *, max(case when state = 'connected' and was is distinct from 'connected' then at_ms end)
                       over (partition by source order by at_ms, seq rows between unbounded preceding and current row) as since from before)
, ce1 as (select source, at_ms, arg_max({'state': state, 'since': case when state = 'connected' then since end}, seq) as s from spells group by 1, 2)
, heard as (select distinct source, received_at_ms from frames)
, grid as (select k.at_ms, c.id, c.url from (select distinct at_ms from rates) k cross join catalog c)
, st as (select g.at_ms, g.id, g.url, coalesce(ce1.s.state, 'disconnected') as state,
                coalesce(r.packets_per_s, 0.0) as packets, coalesce(r.bytes_per_s, 0.0) as bytes,
                cast(floor((g.at_ms - ce1.s.since) / 1000) as bigint) as connected_secs,
                cast(floor((g.at_ms - h.received_at_ms) / 1000) as bigint) as last_packet_secs_ago
         from grid g left join rates r on r.source = g.id and r.at_ms = g.at_ms
           asof left join ce1 on g.id = ce1.source and g.at_ms >= ce1.at_ms
           asof left join heard h on g.id = h.source and g.at_ms >= h.received_at_ms)
, snap as (select at_ms, count(*) as n_sources, string_agg(id, ',' order by id) as source_ids,
                  string_agg(state, ',' order by id) as states,
                  string_agg(concat_ws('|', id, url, state, round(packets, 6)::decimal(20,6), round(bytes, 6)::decimal(20,6),
                                       coalesce(connected_secs::varchar, '-'), coalesce(last_packet_secs_ago::varchar, '-')), ',' order by id) as detail,
                  list({'id': id, 'url': url, 'state': state, 'packets': round(packets, 6)::decimal(20,6), 'bytes': round(bytes, 6)::decimal(20,6),
                        'connected_secs': connected_secs, 'last_packet_secs_ago': last_packet_secs_ago} order by id) as sources,
                  sum(packets) as pps, sum(bytes) * 8 / 1000 as kbps
           from st group by at_ms)
, cpu as (select at_ms, arg_max(pct, event_id) as cpu_percent from (
            select at_ms, event_id, greatest((cpu_seconds - first_value(cpu_seconds) over w)
                   / greatest((at_ms - first_value(at_ms) over w) / 1000.0, 0.001) * 100.0, 0.0) as pct
            from process_samples where instance = 'i-0'
            window w as (partition by instance order by at_ms, event_id rows between 4 preceding and current row)) x
          group by 1)
, mem as (select at_ms, arg_max(rss_bytes, event_id) as rss from process_samples where instance = 'i-0' group by 1)
, cl as (select at_ms, max(c) as clients from (
           select at_ms, sum(case when opened then 1 else -1 end) over (order by at_ms) as c from subscription_events) x group by 1)
, full_snap as (
  select snap.*, coalesce(cpu.cpu_percent, 0.0) as cpu_percent, cast(coalesce(mem.rss, 0) as bigint) as memory_bytes,
         cast(coalesce(cl.clients, 0) as bigint) as clients
  from snap asof left join cpu on snap.at_ms >= cpu.at_ms
            asof left join mem on snap.at_ms >= mem.at_ms
            asof left join cl on snap.at_ms >= cl.at_ms)
"""
)


def _snapshots(spark, sf_dir):
    configure(spark)
    rates = win.sample_rates(fx.counters_from_events(spark, sf_dir))
    ps = fx.process_samples_from_events(spark, sf_dir)
    cpu = win.cpu_percent(ps.filter(F.col("instance") == "i-0"))
    frames = fx.raw_event_frames(spark, sf_dir).select("source", "received_at_ms")
    subs = fx.subscription_events_from_events(spark, sf_dir)
    return hl.telemetry_snapshot(_catalog(spark, sf_dir), rates, _conn(spark, sf_dir), frames, cpu, ps, subs, "i-0")


def _dec(c):
    return F.round(c, 6).cast("decimal(20,6)")


@query(
    "telemetry_snapshot",
    _SNAPSHOT_SQL
    + """select at_ms, n_sources, source_ids, states, detail, round(pps, 6) as pps, round(kbps, 6) as kbps,
       round(cpu_percent, 6) as cpu_percent, memory_bytes, clients from full_snap""",
)
def telemetry_snapshot(spark, sf_dir):
    """One snapshot per tick (all catalog sources sorted by id, all their fields)."""
    s = _snapshots(spark, sf_dir)

    def text(x):
        either = [F.coalesce(x[c].cast("string"), F.lit("-")) for c in ("connected_secs", "last_packet_secs_ago")]
        return F.concat_ws("|", x["id"], x["url"], x["state"], _dec(x["packets"]).cast("string"), _dec(x["bytes"]).cast("string"), *either)

    return s.select(
        "at_ms", F.size("sources").alias("n_sources"),
        F.array_join(F.transform("sources", lambda x: x["id"]), ",").alias("source_ids"),
        F.array_join(F.transform("sources", lambda x: x["state"]), ",").alias("states"),
        F.array_join(F.transform("sources", text), ",").alias("detail"),
        F.round("pps", 6).alias("pps"), F.round("kbps", 6).alias("kbps"), F.round("cpu_percent", 6).alias("cpu_percent"),
        "memory_bytes", "clients",
    )


@query(
    "telemetry_json_latest",
    _SNAPSHOT_SQL
    + """select at_ms, to_json({'sources': sources, 'pps': round(pps, 6)::decimal(20,6), 'kbps': round(kbps, 6)::decimal(20,6),
                          'cpu_percent': round(cpu_percent, 6)::decimal(20,6), 'memory_bytes': memory_bytes,
                          'clients': clients})::varchar as message
from full_snap order by at_ms desc limit 1""",
)
def telemetry_json_latest(spark, sf_dir):
    """Snapshot messages; a new reader first gets the latest one."""
    s = _snapshots(spark, sf_dir)
    item = lambda x: F.struct(x["id"].alias("id"), x["url"].alias("url"), x["state"].alias("state"), _dec(x["packets"]).alias("packets"),
                              _dec(x["bytes"]).alias("bytes"), x["connected_secs"].alias("connected_secs"), x["last_packet_secs_ago"].alias("last_packet_secs_ago"))
    s = s.select(
        "at_ms", F.transform("sources", item).alias("sources"),
        _dec(F.col("pps")).alias("pps"), _dec(F.col("kbps")).alias("kbps"), _dec(F.col("cpu_percent")).alias("cpu_percent"),
        "memory_bytes", "clients",
    )
    return latest_message(telemetry_messages(s))
