"""Connection health from state-change events, frames and rates (H1-H9).

``conn_events(source, at_ms, state, error)`` holds one row per state change;
``tiebreak`` columns order changes that share a millisecond.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from meshframes.functions.scalars import is_live, state_code, state_label
from meshframes.operators.scan import ordered_scan
from meshframes.session import materialize
from meshframes.schema import IDLE_BAD_S, IDLE_WARN_S, UNKNOWN_STATE, ReconnectPolicy

OFFLINE = "offline"


def _order(tiebreak) -> Column:
    return F.struct(F.col("at_ms"), *[F.col(t) for t in tiebreak])


def _catalog_ids(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("id").alias("source")).distinct()


def state_asof(conn_events: DataFrame, at_ms: int, sources: DataFrame | None = None, tiebreak=("seq",)) -> DataFrame:
    """H1 (+P8): last state per source at ``at_ms``; catalog sources without an
    event are disconnected."""
    last = (
        conn_events.filter(F.col("at_ms") <= at_ms)
        .groupBy("source")
        .agg(F.max_by(F.struct("state", "at_ms"), _order(tiebreak)).alias("_last"))
    )
    if sources is not None:
        last = _catalog_ids(sources).join(last, "source", "left")
    state = F.coalesce(F.col("_last.state"), F.lit(UNKNOWN_STATE))
    return last.select("source", state.alias("state"), state_code(state).alias("state_code"),
                       F.col("_last.at_ms").alias("since_ms"))


def connected_seconds(conn_events: DataFrame, at_ms: int, sources: DataFrame | None = None, tiebreak=("seq",)) -> DataFrame:
    """H2: whole seconds since the current connected spell began; null unless the
    state at ``at_ms`` is connected."""
    e = conn_events.filter(F.col("at_ms") <= at_ms).withColumn("_o", _order(tiebreak))
    conn = F.col("state") == "connected"
    last = e.groupBy("source").agg(
        F.max_by("state", "_o").alias("state"),
        F.max(F.when(~conn, F.col("_o"))).alias("_last_off"),
    )
    first_on = (
        e.filter(conn)
        .join(last.select("source", "_last_off"), "source")
        .filter(F.col("_last_off").isNull() | (F.col("_o") > F.col("_last_off")))
        .groupBy("source")
        .agg(F.min("at_ms").alias("connected_since_ms"))
    )
    out = last.join(first_on, "source", "left")
    if sources is not None:
        out = _catalog_ids(sources).join(out, "source", "left")
    secs = F.when(F.col("state") == "connected", F.greatest(F.lit(at_ms) - F.col("connected_since_ms"), F.lit(0)) / 1000)
    return out.select("source", F.floor(secs).cast("long").alias("connected_secs"))


def idle_level(secs) -> Column:
    c = F.col(secs) if isinstance(secs, str) else secs
    return F.when(c >= IDLE_BAD_S, F.lit("bad")).when(c >= IDLE_WARN_S, F.lit("warn")).otherwise(F.lit("ok"))


def last_packet_age(frames: DataFrame, at_ms: int, sources: DataFrame | None = None) -> DataFrame:
    """H3: whole seconds since each source's last packet at ``at_ms`` (null if none)
    and its level: ok, warn from 60 s, bad from 300 s."""
    last = frames.filter(F.col("received_at_ms") <= at_ms).groupBy("source").agg(
        F.max("received_at_ms").alias("last_packet_ms")
    )
    if sources is not None:
        last = _catalog_ids(sources).join(last, "source", "left")
    age = F.floor((F.lit(at_ms) - F.col("last_packet_ms")) / 1000).cast("long")
    return last.select("source", "last_packet_ms", age.alias("last_packet_secs_ago"),
                       F.when(age.isNotNull(), idle_level(age)).alias("idle_level"))


def quiet_sources(states: DataFrame, ages: DataFrame, min_idle_s: int = IDLE_WARN_S) -> DataFrame:
    """H4: connected sources without a packet for ``min_idle_s`` or ever."""
    j = states.join(ages, "source", "left")
    quiet = (F.col("state") == "connected") & (
        F.col("last_packet_secs_ago").isNull() | (F.col("last_packet_secs_ago") >= min_idle_s)
    )
    return j.filter(quiet).select("source", "state", "last_packet_secs_ago", "idle_level")


def episodes(conn_events: DataFrame, tiebreak=("seq",)) -> DataFrame:
    """H5: connected / offline spells per source: start, end (next spell's start,
    null while ongoing), whole seconds, and the number of state changes inside."""
    cls = F.when(F.col("state") == "connected", F.lit("connected")).otherwise(F.lit(OFFLINE))
    e = conn_events.withColumn("_cls", cls)
    s = ordered_scan(e, ["source"], "at_ms", list(tiebreak), lag=["_cls"], lag_prefix="_p")
    flag = F.when(F.col("_p_cls").isNull() | (F.col("_p_cls") != F.col("_cls")), F.lit(1)).otherwise(F.lit(0))
    s = ordered_scan(s.withColumn("_chg", flag), ["source"], "at_ms", list(tiebreak), running_sum={"spell": F.col("_chg")})
    spells = materialize(s.groupBy("source", "spell").agg(
        F.first("_cls").alias("kind"), F.min("at_ms").alias("start_ms"), F.count(F.lit(1)).alias("changes")
    ), "spells")
    nxt = spells.select("source", (F.col("spell") - 1).alias("spell"), F.col("start_ms").alias("end_ms"))
    out = spells.join(nxt, ["source", "spell"], "left")
    return out.select(
        "source", F.col("spell").cast("long").alias("spell"), "kind", "start_ms", "end_ms",
        F.floor((F.col("end_ms") - F.col("start_ms")) / 1000).cast("long").alias("seconds"), "changes",
    )


def retry_waits(conn_events: DataFrame, policy: ReconnectPolicy = ReconnectPolicy(), tiebreak=("seq",)) -> DataFrame:
    """H6: every retry (a reconnect wait) with its kind and the wait due.

    Since the last connect, the k-th normal retry waits ``min(initial * 2^k, max)``;
    a retry is degraded once the source has been offline for the threshold (offline
    since the end of the last connected spell, or the first failed connect if it never
    connected) and then waits the offline delay without raising k. A connect resets
    k. (A degraded wait equal to the current delay would raise k, but every later
    retry of that spell is degraded too, so no wait changes.)
    """
    conn = F.col("state") == "connected"
    retry = F.col("state").isin("reconnect_wait", "reconnect_wait_degraded")
    e = conn_events.withColumn("_conn", F.when(conn, F.lit(1)).otherwise(F.lit(0)))
    s = ordered_scan(e, ["source"], "at_ms", list(tiebreak), running_sum={"_grp": F.col("_conn")})
    begins = F.when(~conn & ((F.col("_grp") > 0) | retry), F.col("at_ms"))
    off = s.groupBy("source", "_grp").agg(F.min(begins).alias("_offline_since"))
    s = s.join(off, ["source", "_grp"], "left")
    degraded = (F.col("at_ms") - F.col("_offline_since")) >= F.lit(int(policy.offline_threshold_s * 1000))
    s = materialize(s.withColumn("_deg", F.coalesce(degraded, F.lit(False))), "retries")
    normal = F.when(retry & ~F.col("_deg"), F.lit(1)).otherwise(F.lit(0))
    s = ordered_scan(s.withColumn("_n", normal), ["source", "_grp"], "at_ms", list(tiebreak), running_sum={"_k": F.col("_n")})
    s = s.filter(retry)
    k = (F.col("_k") - F.col("_n")).cast("long")
    wait = F.when(F.col("_deg"), F.lit(float(policy.offline_delay_s))).otherwise(
        F.least(F.lit(float(policy.initial_delay_s)) * F.pow(F.lit(2.0), k), F.lit(float(policy.max_delay_s)))
    )
    return s.select(
        "source", "at_ms", *tiebreak,
        F.when(F.col("_deg"), F.lit("degraded")).otherwise(F.lit("normal")).alias("kind"),
        F.when(F.col("_deg"), F.lit(None).cast("long")).otherwise(k).alias("attempt"),
        wait.alias("wait_s"),
    )


def status_report(
    sources: DataFrame,
    conn_events: DataFrame,
    frames: DataFrame,
    rates: DataFrame,
    at_ms: int,
    tiebreak=("seq",),
) -> DataFrame:
    """H7: one row per catalog source at ``at_ms``: id, url, state, label, rates of
    the latest tick, connected seconds, last packet age and level, ordered by id."""
    st = state_asof(conn_events, at_ms, sources, tiebreak)
    cs = connected_seconds(conn_events, at_ms, sources, tiebreak)
    age = last_packet_age(frames, at_ms, sources)
    r = (
        rates.filter(F.col("at_ms") <= at_ms)
        .groupBy("source")
        .agg(F.max_by(F.struct("packets_per_s", "bytes_per_s"), "at_ms").alias("_r"))
    )
    out = (
        sources.select(F.col("id").alias("source"), "url")
        .join(st, "source", "left")
        .join(cs, "source", "left")
        .join(age, "source", "left")
        .join(r, "source", "left")
    )
    return out.select(
        F.col("source").alias("id"), "url", "state", state_label("state").alias("label"),
        is_live("state").alias("live"),
        F.coalesce(F.col("_r.packets_per_s"), F.lit(0.0)).alias("packets_per_s"),
        F.coalesce(F.col("_r.bytes_per_s"), F.lit(0.0)).alias("bytes_per_s"),
        "connected_secs", "last_packet_secs_ago", "idle_level",
    ).orderBy("id")


def overall_status(report: DataFrame) -> DataFrame:
    """Status page headline: connected/all and ok / bad / blank."""
    c = report.agg(F.count_if(F.col("state") == "connected").alias("connected"), F.count(F.lit(1)).alias("total"))
    level = (
        F.when((F.col("connected") == F.col("total")) & (F.col("total") > 0), F.lit("ok"))
        .when((F.col("connected") == 0) & (F.col("total") > 0), F.lit("bad"))
        .otherwise(F.lit(""))
    )
    return c.select("connected", "total", level.alias("level"))


def status_table(states: DataFrame, ages: DataFrame) -> DataFrame:
    """H8: dashboard table: up/down and idle seconds merged by source, down first."""
    up = states.select("source", F.when(F.col("state") == "connected", F.lit(1)).otherwise(F.lit(0)).alias("up"))
    idle = ages.select("source", F.col("last_packet_secs_ago").alias("idle_s"))
    j = up.join(idle, "source", "full")
    return j.select(
        "source",
        F.when(F.col("up") == 1, F.lit("up")).when(F.col("up") == 0, F.lit("down")).alias("status"),
        "idle_s",
        F.when(F.col("idle_s").isNotNull(), idle_level("idle_s")).alias("idle_level"),
    ).orderBy(F.col("status").asc_nulls_first(), "source")


#: Grids (milliseconds) that tick times are tried on, coarsest first.
TICK_GRIDS_MS = (3_600_000, 60_000, 10_000, 1_000, 1)
#: Ticks a spell is expanded by at a time, and rows of a scan over ticks that share a task.
TICK_BLOCK = 4_096


def tick_grid(ticks: DataFrame) -> int:
    """The coarsest grid that all tick times (``at_ms``) lie on."""
    on = ticks.agg(*[F.bool_and(F.col("at_ms") % g == 0).alias(str(g)) for g in TICK_GRIDS_MS]).first()
    return next((g for g in TICK_GRIDS_MS if on[str(g)]), 1)


def number_ticks(ticks: DataFrame, grid: int) -> DataFrame:
    """(at_ms, tick): distinct tick times, numbered from 0. A bucket of the scan spans :data:`TICK_BLOCK` grid points, so it can't hold more ticks."""
    t = ticks.select("at_ms").distinct().withColumn("_one", F.lit(0))
    return ordered_scan(t, ["_one"], "at_ms", bucket_ms=grid * TICK_BLOCK, row_number="tick").select("at_ms", "tick")


def _up_to(grid: int, ts: str) -> Column:
    """The grid point at or after a time; no tick lies between the two."""
    return (F.ceil(F.col(ts) / F.lit(grid)) * F.lit(grid)).cast("long").alias("at_ms")


def first_ticks(times: DataFrame, ticks: DataFrame, grid: int) -> DataFrame:
    """(at_ms, tick): for each distinct grid time of ``times`` the first tick at or after it; times after the last tick go."""
    asked = times.select("at_ms").distinct().select("at_ms", F.lit(0).alias("_side"))
    # a tick is seen by the times after it, so the first tick at or after a time is the one after the last seen
    known = ticks.select("at_ms", F.lit(1).alias("_side"), "tick")
    both = asked.unionByName(known, allowMissingColumns=True).withColumn("_one", F.lit(0))
    seen = ordered_scan(both, ["_one"], "at_ms", ["_side"], bucket_ms=grid * TICK_BLOCK, running_max={"_seen": F.col("tick")})
    return seen.where("_side = 0").select("at_ms", (F.coalesce("_seen", F.lit(-1)) + 1).alias("tick"))


def _source_changes(rates: DataFrame, conn_events: DataFrame, frames: DataFrame, grid: int, tiebreak) -> DataFrame:
    """The last state, packet and spell start of each source and grid step, and its rates there."""
    on = F.col("state") == "connected"
    e = ordered_scan(conn_events.select("source", "at_ms", *tiebreak, "state"), ["source"], "at_ms", list(tiebreak), lag=["state"], lag_prefix="_p_")
    begins = F.when(on & ~F.col("_p_state").eqNullSafe(F.lit("connected")), F.col("at_ms"))
    e = e.withColumn("_begins", begins).withColumn("_o", F.struct("at_ms", *tiebreak))
    states = e.groupBy("source", _up_to(grid, "at_ms")).agg(F.max(F.struct("_o", "state")).alias("st"), F.max("_begins").alias("begins"))
    packets = frames.groupBy("source", _up_to(grid, "received_at_ms")).agg(F.max("received_at_ms").alias("lp"))
    sampled = rates.select("source", "at_ms", "packets_per_s", "bytes_per_s")
    return states.unionByName(packets, allowMissingColumns=True).unionByName(sampled, allowMissingColumns=True)


_CHANGES = ("st", "begins", "lp", "packets_per_s", "bytes_per_s")


def sources_at_ticks(sources: DataFrame, changes: DataFrame, last: int) -> DataFrame:
    """One row for each tick up to ``last`` and catalog source: (tick, source, url, state, since, last_packet_ms, packets_per_s, bytes_per_s).

    ``changes`` (source, tick, ...) begin spells that last to the source's next row: a source has a row at the first tick
    and one after the last. A spell is expanded to its ticks in blocks of :data:`TICK_BLOCK`, so a source that says nothing is there at
    every tick, and no row meets rows of other sources. Rates stand at their own tick and are 0 elsewhere.
    """
    bounds = F.array(F.lit(0).cast("long"), F.lit(last + 1).cast("long"))
    ends = sources.select(F.col("id").alias("source")).distinct().select("source", F.explode(bounds).alias("tick"))
    rows = changes.select("source", "tick", *_CHANGES).unionByName(ends, allowMissingColumns=True)
    rows = rows.groupBy("source", "tick").agg(*[F.max(c).alias(c) for c in _CHANGES])
    rows = materialize(rows.join(sources.select(F.col("id").alias("source"), "url").dropDuplicates(["source"]), "source"), "source-spells")
    spells = ordered_scan(rows, ["source"], "tick", bucket_ms=TICK_BLOCK, lag=["tick", "packets_per_s", "bytes_per_s"],
                          max_before={"_st": F.col("st"), "_on": F.col("begins"), "_lp": F.col("lp")}).where("prev_tick is not null")
    block = F.explode(F.sequence(F.floor(F.col("prev_tick") / TICK_BLOCK), F.floor((F.col("tick") - 1) / TICK_BLOCK)))
    blocks = spells.withColumn("_block", block)
    low = F.greatest(F.col("prev_tick"), F.col("_block") * TICK_BLOCK)
    high = F.least(F.col("tick") - 1, F.col("_block") * TICK_BLOCK + TICK_BLOCK - 1)
    dense = blocks.withColumn("_at", F.explode(F.sequence(low, high)))
    here = F.col("_at") == F.col("prev_tick")
    state = F.coalesce("_st.state", F.lit(UNKNOWN_STATE))
    return dense.select(
        F.col("_at").alias("tick"), "source", "url", state.alias("state"), F.when(state == "connected", F.col("_on")).alias("since"),
        F.col("_lp").alias("last_packet_ms"),
        *[F.when(here, F.coalesce(f"prev_{c}", F.lit(0.0))).otherwise(F.lit(0.0)).alias(c) for c in ("packets_per_s", "bytes_per_s")],
    )


def telemetry_snapshot(
    sources: DataFrame,
    rates: DataFrame,
    conn_events: DataFrame,
    frames: DataFrame,
    cpu: DataFrame,
    process_samples: DataFrame,
    subscription_events: DataFrame,
    instance: str,
    tiebreak=("seq",),
    sample_tiebreak=("event_id",),
) -> DataFrame:
    """H9: one snapshot per tick (a distinct ``at_ms`` of ``rates``): every catalog source, sorted by id, with url, state, packet and byte rate
    (0 without a sample at the tick), whole connected seconds (null unless connected) and whole seconds since its last packet (null before the
    first); their total rates; CPU percent and memory of ``instance``; open subscriptions.

    All inputs are reduced to a row for each step of the ticks' grid (and source) before they meet the ticks: the last state, packet and
    sample, the sum of opened less closed subscriptions. Only the distinct steps are looked up among the ticks. What is not about sources
    is then carried on from tick to tick by a scan over blocks of ticks.
    """
    rates = materialize(rates, "snapshot-rates")
    grid = tick_grid(rates)
    ticks = materialize(number_ticks(rates, grid), "ticks")
    last = ticks.agg(F.max("tick").alias("n")).first()["n"]
    last = -1 if last is None else last

    def sample(df: DataFrame, c: str) -> DataFrame:
        own = df.where(F.col("instance") == instance)
        return own.withColumn("_o", F.struct("at_ms", *sample_tiebreak)).groupBy(_up_to(grid, "at_ms")).agg(F.max(F.struct("_o", c)).alias(f"_{c}"))

    delta = F.when(F.col("opened"), F.lit(1)).otherwise(F.lit(-1))
    parts = [
        _source_changes(rates, conn_events, frames, grid, tiebreak), sample(cpu, "cpu_percent"), sample(process_samples, "rss_bytes"),
        subscription_events.groupBy(_up_to(grid, "at_ms")).agg(F.sum(delta).alias("_d")),
    ]
    changes = materialize(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "snapshot-changes")
    at = materialize(first_ticks(changes, ticks, grid).where(F.col("tick") <= last), "first-ticks")
    changes = changes.join(at, "at_ms").drop("at_ms")

    per_source = sources_at_ticks(sources, changes.where("source is not null"), last)
    item = F.struct(F.col("source").alias("id"), "url", "state", F.col("packets_per_s").alias("packets"), F.col("bytes_per_s").alias("bytes"), "since", "last_packet_ms")
    snap = per_source.groupBy("tick").agg(
        F.sort_array(F.collect_list(item)).alias("_sources"), F.sum("packets_per_s").alias("pps"), (F.sum("bytes_per_s") * 8 / 1000).alias("kbps"))

    own = changes.where("source is null").select("tick", "_cpu_percent", "_rss_bytes", "_d").unionByName(ticks.select("tick"), allowMissingColumns=True)
    process = own.groupBy(F.lit(0).alias("_one"), "tick").agg(
        F.max("_cpu_percent").alias("_c"), F.max("_rss_bytes").alias("_m"), F.coalesce(F.sum("_d"), F.lit(0)).alias("_d"))
    process = ordered_scan(process, ["_one"], "tick", bucket_ms=TICK_BLOCK, running_max={"c": F.col("_c"), "m": F.col("_m")}, running_sum={"clients": F.col("_d")})
    whole = snap.join(process.join(ticks, "tick"), "tick")

    def seconds(since: Column) -> Column:
        return F.when(since.isNotNull(), F.floor(F.greatest(F.col("at_ms") - since, F.lit(0)) / 1000).cast("long"))

    listed = F.transform("_sources", lambda x: F.struct(
        x["id"].alias("id"), x["url"].alias("url"), x["state"].alias("state"), x["packets"].alias("packets"), x["bytes"].alias("bytes"),
        seconds(x["since"]).alias("connected_secs"), seconds(x["last_packet_ms"]).alias("last_packet_secs_ago")))
    return whole.select(
        "at_ms", listed.alias("sources"), "pps", "kbps",
        F.coalesce("c.cpu_percent", F.lit(0.0)).alias("cpu_percent"),
        F.coalesce("m.rss_bytes", F.lit(0)).cast("long").alias("memory_bytes"),
        F.col("clients").cast("long").alias("clients"),
    )
