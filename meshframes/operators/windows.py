"""Rates, histories and gaps over counter samples and frames.

Counters are cumulative samples per source and tick. Rates follow two rules on
purpose: the snapshot rate (W1) saturates a falling counter to 0; the range rate
(W5/W6/W8) treats a fall as a reset (the new value is the increase).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshframes.operators.scan import ordered_scan, range_sum
from meshframes.session import materialize
from meshframes.schema import (
    CPU_WINDOW_SAMPLES,
    HISTORY_LEN,
    INCREASE_ORANGE,
    INCREASE_RED,
    MIN_ELAPSED_S,
    SPARK_HEIGHT,
    STATUS_INTERVAL_S,
)

_ONE_KEY = "_one"


def tick_elapsed(counters: DataFrame, ts: str = "at_ms") -> DataFrame:
    """Previous tick (over all sources) of each tick and the seconds between them,
    at least 0.001; null for the first tick. Ticks are distinct sample times."""
    ticks = counters.select(ts).distinct().withColumn(_ONE_KEY, F.lit(0))
    t = ordered_scan(ticks, [_ONE_KEY], ts, lag=[ts], lag_prefix="_prev_")
    elapsed = F.greatest((F.col(ts) - F.col(f"_prev_{ts}")) / 1000.0, F.lit(MIN_ELAPSED_S))
    return t.select(ts, F.col(f"_prev_{ts}").alias("prev_tick_ms"), elapsed.alias("elapsed_s"))


def _rates(counters: DataFrame, cols) -> DataFrame:
    s = ordered_scan(counters, ["source"], "at_ms", lag=[*cols, "at_ms"], lag_prefix="_prev_")
    s = s.join(tick_elapsed(counters), "at_ms", "left")
    el = F.coalesce(F.col("elapsed_s"), F.lit(MIN_ELAPSED_S))
    out = [F.col("source"), F.col("at_ms")]
    for c in cols:
        delta = F.when(F.col(f"_prev_{c}").isNull(), F.lit(0)).otherwise(
            F.greatest(F.col(c) - F.col(f"_prev_{c}"), F.lit(0))
        )
        out.append((delta / el).alias(f"{c}_per_s"))
    # the source was absent from the previous tick (or this is its first sample)
    gap = F.col("_prev_at_ms").isNull() | ~F.col("_prev_at_ms").eqNullSafe(F.col("prev_tick_ms"))
    return s.select(*out, gap.alias("_new_run"))


def sample_rates(counters: DataFrame, cols=("packets", "bytes")) -> DataFrame:
    """Per source and tick, ``<c>_per_s`` = saturating delta / tick elapsed.

    A source's first sample gives 0; a counter that went down gives 0.
    """
    return _rates(counters, list(cols)).drop("_new_run")


def increments(counters: DataFrame, cols=("packets", "bytes"), keys=("source",), ts="at_ms", tiebreak=()) -> DataFrame:
    """Reset-aware increase per sample: ``v - prev`` or ``v`` when the counter fell
    (restart); the first sample of a key adds nothing."""
    s = ordered_scan(counters, list(keys), ts, list(tiebreak), lag=list(cols), lag_prefix="_prev_")
    for c in cols:
        p = F.col(f"_prev_{c}")
        inc = F.when(p.isNull(), F.lit(0)).when(F.col(c) < p, F.col(c)).otherwise(F.col(c) - p)
        s = s.withColumn(f"{c}_inc", inc)
    return s.drop(*[f"_prev_{c}" for c in cols])


def interval_status(counters: DataFrame, interval_s: float = STATUS_INTERVAL_S, cols=("packets", "bytes")) -> DataFrame:
    """Relay-wide packets/s and kilobytes/s per status interval, divided by the
    nominal interval length (not the real elapsed time)."""
    inc = increments(counters, cols)
    width = int(interval_s * 1000)
    g = inc.groupBy((F.floor(F.col("at_ms") / width) * width).cast("long").alias("interval_ms")).agg(
        F.sum("packets_inc").alias("_p"), F.sum("bytes_inc").alias("_b")
    )
    return g.select(
        "interval_ms",
        (F.col("_p") / F.lit(interval_s)).alias("pps"),
        (F.col("_b") / F.lit(interval_s) / 1000.0).alias("kbyte_s"),
    )


def range_rate(counters: DataFrame, range_s: int, cols=("packets", "bytes"), by_source: bool = True) -> DataFrame:
    """Reset-aware per-second rate over the trailing range, at every sample.

    Sum of increases in ``(t - range, t]`` / range; no edge extrapolation.
    ``bits_per_s`` = bytes rate * 8. ``by_source=False`` sums the per-source rates
    per sample time.
    """
    inc = increments(counters, cols)
    width = int(range_s) * 1000
    r = range_sum(inc, ["source"], "at_ms", width, {f"_{c}_sum": F.col(f"{c}_inc") for c in cols})
    out = r.select("source", "at_ms", *[(F.col(f"_{c}_sum") / F.lit(float(range_s))).alias(f"{c}_per_s") for c in cols])
    if "bytes" in cols:
        out = out.withColumn("bits_per_s", F.col("bytes_per_s") * 8)
    if not by_source:
        out = out.groupBy("at_ms").agg(*[F.sum(c).alias(c) for c in out.columns if c.endswith("_per_s")])
    return out


def increase_level(v) -> Column:
    """Dashboard level of an increase: green below 1, orange from 1, red from 10."""
    c = F.col(v) if isinstance(v, str) else v
    return F.when(c >= INCREASE_RED, F.lit("red")).when(c >= INCREASE_ORANGE, F.lit("orange")).otherwise(F.lit("green"))


def range_increase(counters: DataFrame, range_s: int, cols=("packets",), tiebreak=()) -> DataFrame:
    """Reset-aware increase over the trailing range, with its level."""
    inc = increments(counters, cols, tiebreak=tiebreak)
    width = int(range_s) * 1000
    r = range_sum(inc, ["source"], "at_ms", width, {f"{c}_increase": F.col(f"{c}_inc") for c in cols})
    out = r.select("source", "at_ms", *tiebreak, *[F.col(f"{c}_increase").cast("long") for c in cols])
    for c in cols:
        out = out.withColumn(f"{c}_level", increase_level(f"{c}_increase"))
    return out


def event_counters(conn_events: DataFrame, tiebreak=("seq",)) -> DataFrame:
    """Cumulative reconnect and error counters per source at every state change
    (what the relay's per-source metrics count)."""
    retry = F.col("state").isin("reconnect_wait", "reconnect_wait_degraded")
    s = ordered_scan(conn_events, ["source"], "at_ms", list(tiebreak), running_sum={
        "reconnects": F.when(retry, F.lit(1)).otherwise(F.lit(0)),
        "errors": F.when(F.col("error").isNotNull(), F.lit(1)).otherwise(F.lit(0)),
    })
    return s.select("source", "at_ms", *tiebreak, F.col("reconnects").cast("long"), F.col("errors").cast("long"))


def cpu_percent(samples: DataFrame, tiebreak=("event_id",)) -> DataFrame:
    """(newest - oldest) / span * 100 over the last 5 samples incl. the current
    one, at least 0, span at least 0.001 s. A missing reading reuses the last one."""
    ff = F.when(F.col("cpu_seconds").isNotNull(), F.struct("at_ms", *tiebreak, "cpu_seconds"))
    s = ordered_scan(samples, ["instance"], "at_ms", list(tiebreak), running_max={"_ff": ff})
    s = materialize(s.withColumn("_cpu", F.col("_ff.cpu_seconds")).drop("_ff"), "cpu-filled")
    s = ordered_scan(
        s, ["instance"], "at_ms", list(tiebreak),
        tail={"_hist": (F.struct(F.col("at_ms"), F.col("_cpu")), CPU_WINDOW_SAMPLES)},
    )
    oldest = F.col("_hist")[0]
    span = F.greatest((F.col("at_ms") - oldest["at_ms"]) / 1000.0, F.lit(MIN_ELAPSED_S))
    pct = F.greatest((F.coalesce(F.col("_cpu"), F.lit(0.0)) - F.coalesce(oldest["_cpu"], F.lit(0.0))) / span * 100.0, F.lit(0.0))
    return s.select("instance", "at_ms", *tiebreak, pct.alias("cpu_percent"))


def trailing_history(counters: DataFrame, value: str = "packets_per_s", n: int = HISTORY_LEN) -> DataFrame:
    """Per source the last ``n`` snapshot rates, oldest first, and bar heights.

    Height: value > 0 -> max(2, v / max(values, 1) * 26), else 1. A source missing
    from a tick loses its history (it restarts at its next sample): the tail keeps
    (value, restart) pairs and is cut after its last restart.
    """
    r = materialize(_rates(counters, ["packets", "bytes"]), "rates")
    r = ordered_scan(r, ["source"], "at_ms", tail={"_t": (F.struct(F.col(value).alias("v"), F.col("_new_run").alias("b")), n)})
    # index (1-based) of the last restart in the tail; the history starts there
    last_start = F.aggregate(
        F.transform(F.col("_t"), lambda x, i: F.when(x["b"], i + 1).otherwise(F.lit(0))),
        F.lit(0), lambda acc, x: F.greatest(acc, x))
    hist = F.transform(F.slice(F.col("_t"), F.greatest(last_start, F.lit(1)), F.lit(n)), lambda x: x["v"])
    r = r.withColumn("history", hist)
    mx = F.greatest(F.array_max("history"), F.lit(1.0))
    heights = F.transform(
        "history", lambda v: F.when(v > 0, F.greatest(F.lit(2.0), v / mx * SPARK_HEIGHT)).otherwise(F.lit(1.0))
    )
    return r.select("source", "at_ms", "history", heights.alias("heights"))


def sequence_gaps(frames: DataFrame, order: str = "received_at_ms", tiebreak=("sequence",)) -> DataFrame:
    """Per source, where sequence numbers were skipped: gap start and count.

    A sequence that falls back to 0 is a restart (new runtime), not a gap.
    """
    s = ordered_scan(frames, ["source"], order, [t for t in tiebreak if t != order], lag=["sequence"], lag_prefix="_prev_")
    prev = F.col("_prev_sequence")
    gap = prev.isNotNull() & (F.col("sequence") != 0) & (F.col("sequence") - prev > 1)
    return s.filter(gap).select(
        "source",
        (prev + 1).alias("gap_start"),
        (F.col("sequence") - prev - 1).alias("skipped"),
        F.col(order).alias("seen_at") if order != "sequence" else F.col("sequence").alias("resumed_at"),
    )


def runtime_gaps(frames: DataFrame, order: str = "received_at_ms", tiebreak=()) -> DataFrame:
    """W7 with restarts: per source and runtime, where sequence numbers were skipped.

    Frames are taken as they arrived (``order``, then ``tiebreak``). A sequence that falls back begins a new runtime, whose numbers begin at 0: what lies
    before its first frame was skipped too. How many frames the old runtime sent after its last one isn't known, so its
    tail is a row with ``skipped`` null. ``runtime`` counts a source's restarts from 0; ``seen_at`` is the arrival that shows the gap."""
    behind = ordered_scan(frames.select("source", "sequence", order, *[t for t in tiebreak if t not in ("sequence", order)]), ["source"], order, list(tiebreak), lag=["sequence"], lag_prefix="_prev_")
    prev = F.col("_prev_sequence")
    marked = materialize(behind.withColumn("_restart", (prev.isNotNull() & (F.col("sequence") <= prev)).cast("int")), "runtime-restarts")
    runs = ordered_scan(marked, ["source"], order, list(tiebreak), running_sum={"runtime": F.col("_restart")})
    first = prev.isNull() | (F.col("_restart") == 1)
    start = F.when(first, F.lit(0)).otherwise(prev + 1)
    number = F.col("runtime").cast("long")
    gap = F.when(F.col("sequence") > start, F.struct(number.alias("runtime"), start.cast("long").alias("gap_start"), (F.col("sequence") - start).cast("long").alias("skipped")))
    tail = F.when(F.col("_restart") == 1, F.struct((number - 1).alias("runtime"), (prev + 1).cast("long").alias("gap_start"), F.lit(None).cast("long").alias("skipped")))
    found = runs.select("source", F.explode(F.filter(F.array(tail, gap), lambda g: g.isNotNull())).alias("_g"), F.col(order).alias("seen_at"))
    return found.select("source", "_g.*", "seen_at")


def process_rates(samples: DataFrame, range_s: int = 60) -> DataFrame:
    """CPU rate over the range * 100, RSS, open/max fds, uptime."""
    inc = increments(samples, ("cpu_seconds",), keys=("instance",), tiebreak=("event_id",))
    width = int(range_s) * 1000
    r = range_sum(inc, ["instance"], "at_ms", width, {"_cpu": F.col("cpu_seconds_inc")})
    return r.select(
        "instance",
        "at_ms",
        "event_id",
        (F.col("_cpu") / F.lit(float(range_s)) * 100.0).alias("cpu_rate_percent"),
        "rss_bytes",
        "open_fds",
        "max_fds",
        (F.col("at_ms") / 1000.0 - F.col("start_time_s")).alias("uptime_s"),
    )


def counters(frames: DataFrame, conn_events: DataFrame, tick_ms: int = 10_000, tiebreak=("seq",)) -> DataFrame:
    """The relay's cumulative counters per source, at every tick in whose interval a frame or a state change fell:
    packets, bytes, reconnects, errors, connected (0 or 1) and the time of the last packet (null before the first), as
    they stand at ``at_ms`` (the interval's end; its start is counted, its end is not).

    Frames and events are reduced to a row for each (source, interval) before the running totals."""
    def tick(c: str) -> Column:
        return ((F.floor(F.col(c) / F.lit(tick_ms)) + 1) * F.lit(tick_ms)).cast("long").alias("at_ms")

    p = frames.groupBy("source", tick("received_at_ms")).agg(
        F.count(F.lit(1)).alias("p"), F.sum("payload_bytes").alias("b"), F.max("received_at_ms").alias("last"))
    retry = F.col("state").isin("reconnect_wait", "reconnect_wait_degraded")
    e = conn_events.withColumn("_at", tick("at_ms")).groupBy("source", F.col("_at").alias("at_ms")).agg(
        F.count_if(retry).alias("r"), F.count_if(F.col("error").isNotNull()).alias("x"),
        F.max_by((F.col("state") == "connected").cast("int"), F.struct("at_ms", *tiebreak)).alias("c"))
    both = p.unionByName(e, allowMissingColumns=True).groupBy("source", "at_ms").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("p", "b", "r", "x")], F.max("last").alias("last"), F.max("c").alias("c"))
    both = materialize(both, "counter-ticks")
    s = ordered_scan(both, ["source"], "at_ms", bucket_ms=max(3_600_000, 1000 * tick_ms),
                     running_sum={"packets": F.col("p"), "bytes": F.col("b"), "reconnects": F.col("r"), "errors": F.col("x")},
                     running_max={"last_packet_ms": F.col("last"), "_c": F.when(F.col("c").isNotNull(), F.struct("at_ms", "c"))})
    return s.select("source", "at_ms", *[F.col(c).cast("long") for c in ("packets", "bytes", "reconnects", "errors")],
                    F.coalesce(F.col("_c.c"), F.lit(0)).cast("int").alias("connected"), "last_packet_ms")
