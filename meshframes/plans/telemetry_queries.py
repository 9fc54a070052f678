"""Queries over counters, process samples and subscription events (A, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshframes import fixtures as fx
from meshframes.operators import aggregates as agg
from meshframes.operators import filters as flt
from meshframes.operators import windows as win
from meshframes.plans.registry import query
from meshframes.plans.sql import CONN_EVENTS, CONV_GAPS, COUNTERS, FRAMES, PROCESS_SAMPLES, RESTARTED, SUBSCRIPTION_EVENTS, with_
from meshframes.session import configure


def _counters(spark, sf_dir):
    configure(spark)
    return fx.counters_from_events(spark, sf_dir)


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


_RATES_SQL = """
, t as (select at_ms, lag(at_ms) over (order by at_ms) as pt from (select distinct at_ms from counters) d)
, s as (select c.*, lag(packets) over (partition by source order by at_ms) as pp,
               lag(bytes) over (partition by source order by at_ms) as pb from counters c)
, rates as (
  select s.source, s.at_ms,
         (case when pp is null then 0 else greatest(packets - pp, 0) end)
           / coalesce(greatest((t.at_ms - t.pt) / 1000.0, 0.001), 0.001) as packets_per_s,
         (case when pb is null then 0 else greatest(bytes - pb, 0) end)
           / coalesce(greatest((t.at_ms - t.pt) / 1000.0, 0.001), 0.001) as bytes_per_s
  from s join t on s.at_ms = t.at_ms)
"""


@query("sample_rates", with_(COUNTERS) + _RATES_SQL + "select source, at_ms, round(packets_per_s, 6) as packets_per_s, round(bytes_per_s, 6) as bytes_per_s from rates")
def sample_rates(spark, sf_dir):
    """Per-source snapshot rates (saturating delta / tick elapsed)."""
    r = win.sample_rates(_counters(spark, sf_dir))
    return r.select("source", "at_ms", _r6("packets_per_s"), _r6("bytes_per_s"))


@query("snapshot_totals", with_(COUNTERS) + _RATES_SQL + "select at_ms, round(sum(packets_per_s), 6) as pps, round(sum(bytes_per_s) * 8 / 1000, 6) as kbit_s from rates group by at_ms")
def snapshot_totals(spark, sf_dir):
    """A3: pps and kilobits/s per tick from per-source rates."""
    t = agg.snapshot_totals(win.sample_rates(_counters(spark, sf_dir)))
    return t.select("at_ms", _r6("pps"), _r6("kbit_s"))


_INC_SQL = """
, inc as (select source, at_ms,
         case when lag(packets) over w is null then 0 when packets < lag(packets) over w then packets
              else packets - lag(packets) over w end as packets_inc,
         case when lag(bytes) over w is null then 0 when bytes < lag(bytes) over w then bytes
              else bytes - lag(bytes) over w end as bytes_inc
  from counters window w as (partition by source order by at_ms))
"""


@query(
    "interval_status",
    with_(COUNTERS) + _INC_SQL
    + """select cast((at_ms // 10000) * 10000 as bigint) as interval_ms, round(sum(packets_inc) / 10.0, 6) as pps,
       round(sum(bytes_inc) / 10.0 / 1000.0, 6) as kbyte_s from inc group by 1""",
)
def interval_status(spark, sf_dir):
    """Relay-wide packets/s and kilobytes/s per 10 s status interval (nominal divisor)."""
    r = win.interval_status(_counters(spark, sf_dir))
    return r.select("interval_ms", _r6("pps"), _r6("kbyte_s"))


@query(
    "range_rate_5m",
    with_(COUNTERS) + _INC_SQL
    + """select source, at_ms, round(p / 300.0, 6) as packets_per_s, round(b / 300.0, 6) as bytes_per_s,
       round(b / 300.0 * 8, 6) as bits_per_s from (
  select source, at_ms, sum(packets_inc) over w as p, sum(bytes_inc) over w as b
  from inc window w as (partition by source order by at_ms range between 299999 preceding and current row)) x""",
)
def range_rate_5m(spark, sf_dir):
    """Reset-aware rate over 5 minutes per source; bandwidth in bits/s."""
    r = win.range_rate(_counters(spark, sf_dir), 300)
    return r.select("source", "at_ms", _r6("packets_per_s"), _r6("bytes_per_s"), _r6("bits_per_s"))


@query(
    "range_increase_1h",
    with_(COUNTERS) + _INC_SQL
    + """select source, at_ms, cast(p as bigint) as packets_increase,
       case when p >= 10 then 'red' when p >= 1 then 'orange' else 'green' end as packets_level from (
  select source, at_ms, sum(packets_inc) over (partition by source order by at_ms range between 3599999 preceding and current row) as p
  from inc) x""",
)
def range_increase_1h(spark, sf_dir):
    """Reset-aware increase over 1 h with its green/orange/red level."""
    return win.range_increase(_counters(spark, sf_dir), 3600)


@query(
    "trailing_history",
    with_(COUNTERS) + _RATES_SQL
    + """
, tk as (select at_ms, row_number() over (order by at_ms) as tick from (select distinct at_ms from rates) d)
, r as (select rates.*, tick, lag(tick) over (partition by source order by rates.at_ms) as ptick
        from rates join tk on rates.at_ms = tk.at_ms)
, g as (select *, sum(case when ptick is null or tick - ptick > 1 then 1 else 0 end)
                  over (partition by source order by at_ms rows between unbounded preceding and current row) as seg from r)
, h as (select source, at_ms, list(packets_per_s) over (partition by source, seg order by at_ms rows between 29 preceding and current row) as history from g)
, hh as (select *, list_transform(history, lambda v: case when v > 0 then greatest(2.0, v / greatest(list_max(history), 1.0) * 26.0) else 1.0 end) as heights from h)
select source, at_ms, cast(len(history) as integer) as n_points, round(list_sum(history), 6) as history_sum,
       round(list_sum(heights), 6) as heights_sum, round(list_max(heights), 6) as max_height from hh""",
)
def trailing_history(spark, sf_dir):
    """Last 30 packet rates per source and their bar heights."""
    h = win.trailing_history(_counters(spark, sf_dir))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return h.select(
        "source", "at_ms", F.size("history").alias("n_points"), F.round(total(F.col("history")), 6).alias("history_sum"),
        F.round(total(F.col("heights")), 6).alias("heights_sum"), F.round(F.array_max("heights"), 6).alias("max_height"),
    )


@query(
    "sequence_gaps",
    with_(CONV_GAPS)
    + """select source, prev + 1 as gap_start, sequence - prev - 1 as skipped, sequence as resumed_at from (
  select source, sequence, lag(sequence) over (partition by source order by sequence) as prev from conv_frames) x
where prev is not null and sequence <> 0 and sequence - prev > 1""",
)
def sequence_gaps(spark, sf_dir):
    """Skipped turns per conversation (rows removed from conversations)."""
    configure(spark)
    g = fx.conversation_gaps(spark, sf_dir)
    return win.sequence_gaps(g, order="sequence", tiebreak=())


@query(
    "runtime_gaps",
    with_(RESTARTED)
    + """
, l as (select *, lag(sequence) over (partition by source order by received_at_ms, event_id) as prev from restarted)
, m as (select *, case when prev is not null and sequence <= prev then 1 else 0 end as again from l)
, n as (select *, sum(again) over (partition by source order by received_at_ms, event_id rows between unbounded preceding and current row) as runtime from m)
select source, cast(runtime as bigint) as runtime, case when prev is null or again = 1 then 0 else prev + 1 end as gap_start,
       sequence - case when prev is null or again = 1 then 0 else prev + 1 end as skipped, received_at_ms as seen_at
from n where sequence > case when prev is null or again = 1 then 0 else prev + 1 end
union all select source, cast(runtime - 1 as bigint), prev + 1, null, received_at_ms from n where again = 1""",
)
def runtime_gaps(spark, sf_dir):
    """W7 with restarts: sources that begin anew every 10 days, in arrival order."""
    configure(spark)
    return win.runtime_gaps(fx.restarted_frames(spark, sf_dir), tiebreak=("event_id",))


@query(
    "cpu_percent",
    with_(PROCESS_SAMPLES)
    + """select instance, at_ms, event_id,
       round(greatest((cpu_seconds - first_value(cpu_seconds) over w)
                      / greatest((at_ms - first_value(at_ms) over w) / 1000.0, 0.001) * 100.0, 0.0), 6) as cpu_percent
from process_samples window w as (partition by instance order by at_ms, event_id rows between 4 preceding and current row)""",
)
def cpu_percent(spark, sf_dir):
    """CPU percent over the last 5 samples per instance."""
    configure(spark)
    c = win.cpu_percent(fx.process_samples_from_events(spark, sf_dir))
    return c.select("instance", "at_ms", "event_id", _r6("cpu_percent"))


@query(
    "process_rates",
    with_(PROCESS_SAMPLES)
    + """
, inc as (select *, case when lag(cpu_seconds) over w is null then 0 when cpu_seconds < lag(cpu_seconds) over w then cpu_seconds
                          else cpu_seconds - lag(cpu_seconds) over w end as ci
          from process_samples window w as (partition by instance order by at_ms, event_id))
select instance, at_ms, event_id,
       round(sum(ci::decimal(20,2)) over (partition by instance order by at_ms range between 59999 preceding and current row) / 60.0 * 100.0, 6) as cpu_rate_percent,
       rss_bytes, open_fds, max_fds, round(at_ms / 1000.0 - start_time_s, 6) as uptime_s
from inc""",
)
def process_rates(spark, sf_dir):
    """CPU rate over 1 min * 100, RSS, fds, uptime per process sample."""
    configure(spark)
    s = fx.process_samples_from_events(spark, sf_dir)
    r = win.process_rates(s, 60)
    return r.select("instance", "at_ms", "event_id", _r6("cpu_rate_percent"), "rss_bytes", "open_fds", "max_fds", _r6("uptime_s"))


@query(
    "client_counts",
    with_(SUBSCRIPTION_EVENTS)
    + """select subscription_id, at_ms, event_id, opened, source,
       sum(case when opened then 1 else -1 end) over w as clients,
       sum(case when source is null then (case when opened then 1 else -1 end) else 0 end) over w as all_source_clients,
       sum(case when source is null then 0 else (case when opened then 1 else -1 end) end) over w as per_source_clients
from subscription_events window w as (order by at_ms, subscription_id, event_id rows between unbounded preceding and current row)""",
)
def client_counts(spark, sf_dir):
    """A5: open subscriptions after every open/close, all-source and per-source."""
    configure(spark)
    e = fx.subscription_events_from_events(spark, sf_dir)
    return agg.client_counts(e, tiebreak=("subscription_id", "event_id"))


@query("label_values", with_(COUNTERS) + "select distinct source from counters")
def label_values(spark, sf_dir):
    """Distinct source label values."""
    return agg.label_values(_counters(spark, sf_dir), "source")


@query(
    "source_pattern",
    with_(COUNTERS) + "select source, at_ms, packets from counters where regexp_full_match(source, 'src-[1-3]|src-7')",
)
def source_pattern(spark, sf_dir):
    """fully anchored multi-value source pattern."""
    c = flt.filter_source_pattern(_counters(spark, sf_dir), "src-[1-3]|src-7")
    return c.select("source", "at_ms", "packets")


@query(
    "error_increase_1h",
    with_(CONN_EVENTS)
    + """
, cum as (select source, at_ms, seq,
                 sum(case when state in ('reconnect_wait', 'reconnect_wait_degraded') then 1 else 0 end) over w as reconnects,
                 sum(case when error is not null then 1 else 0 end) over w as errors
          from conn_events window w as (partition by source order by at_ms, seq rows between unbounded preceding and current row))
, inc as (select source, at_ms, seq,
                 case when lag(reconnects) over v is null then 0 when reconnects < lag(reconnects) over v then reconnects
                      else reconnects - lag(reconnects) over v end as ri,
                 case when lag(errors) over v is null then 0 when errors < lag(errors) over v then errors
                      else errors - lag(errors) over v end as ei
          from cum window v as (partition by source order by at_ms, seq))
, r as (select source, at_ms, seq, sum(ri) over x as ri, sum(ei) over x as ei
        from inc window x as (partition by source order by at_ms range between 3599999 preceding and current row))
select source, at_ms, seq, cast(ri as bigint) as reconnects_increase,
       case when ri >= 10 then 'red' when ri >= 1 then 'orange' else 'green' end as reconnects_level,
       cast(ei as bigint) as errors_increase,
       case when ei >= 10 then 'red' when ei >= 1 then 'orange' else 'green' end as errors_level
from r""",
)
def error_increase_1h(spark, sf_dir):
    """Reset-aware 1 h increase of reconnects and errors per source, with levels."""
    configure(spark)
    c = win.event_counters(fx.conn_events_from_events(spark, sf_dir))
    return win.range_increase(c, 3600, cols=("reconnects", "errors"), tiebreak=("seq",))


@query(
    "range_rate_total_1m",
    with_(COUNTERS) + _INC_SQL
    + """select at_ms, round(sum(p) / 60.0, 6) as packets_per_s, round(sum(b) / 60.0, 6) as bytes_per_s,
       round(sum(b) / 60.0 * 8, 6) as bits_per_s from (
  select source, at_ms, sum(packets_inc) over w as p, sum(bytes_inc) over w as b
  from inc window w as (partition by source order by at_ms range between 59999 preceding and current row)) x
group by at_ms""",
)
def range_rate_total_1m(spark, sf_dir):
    """W5 (total): relay-wide reset-aware rate over 1 minute; bandwidth in bits/s."""
    r = win.range_rate(_counters(spark, sf_dir), 60, by_source=False)
    return r.select("at_ms", _r6("packets_per_s"), _r6("bytes_per_s"), _r6("bits_per_s"))


@query(
    "counters_from_frames",
    with_(FRAMES, CONN_EVENTS)
    + """
, t as (
  select source, (received_at_ms // 600000 + 1) * 600000 as at_ms, count(*) as p, sum(payload_bytes) as b, max(received_at_ms) as last,
         0 as r, 0 as x, cast(null as integer) as c from frames group by 1, 2
  union all
  select source, (at_ms // 600000 + 1) * 600000, 0, 0, null, count_if(state in ('reconnect_wait', 'reconnect_wait_degraded')), count(error),
         cast(arg_max(state = 'connected', {'t': at_ms, 's': seq}) as integer) from conn_events group by 1, 2)
, g as (select source, at_ms, sum(p) as p, sum(b) as b, max(last) as last, sum(r) as r, sum(x) as x, max(c) as c from t group by 1, 2)
select source, cast(at_ms as bigint) as at_ms, cast(sum(p) over w as bigint) as packets, cast(sum(b) over w as bigint) as bytes,
       cast(sum(r) over w as bigint) as reconnects, cast(sum(x) over w as bigint) as errors,
       coalesce(last_value(c ignore nulls) over w, 0) as connected, max(last) over w as last_packet_ms
from g window w as (partition by source order by at_ms rows between unbounded preceding and current row)""",
)
def counters_from_frames(spark, sf_dir):
    """Cumulative counters per source and 10-minute tick from frames and state changes."""
    configure(spark)
    frames = fx.frames_from_events(spark, sf_dir, decode=False)
    return win.counters(frames, fx.conn_events_from_events(spark, sf_dir), 600_000)
