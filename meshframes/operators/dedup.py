"""Content dedup over frames.

The relay keeps, per subscriber, two generations of seen content hashes; a frame
whose hash is in either is dropped and not re-recorded. Three readings exist:

* ``dedup_aligned`` (D2): generations fixed at ``floor(ms / W)``. Deterministic and
  fully distributed: only the first frame of a hash in a generation can pass, and
  within a run of consecutive generations holding the hash every other one passes.
* ``dedup_replay`` (D1): generations rotate on arrivals, as the relay does, from the
  subscription start. Rotation times are a chain (next rotation = first arrival at
  least W after the last), resolved by composing tiles of time (``operators.rotation``).
* ``dedup_first`` (D4): Spark's ``dropDuplicates`` (batch) - first copy only.

Frames without a hash always pass. The rules work on narrow rows (hash, time, source, sequence), which a partial aggregation
reduces to one per (hash, generation); whole frames take part in the last semi-join only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from meshframes.operators.rotation import rotation_generations
from meshframes.operators.scan import ROWS_PER_BUCKET, ordered_scan, run_starts
from meshframes.session import materialize

ARRIVAL_ORDER = ("received_at_ms", "source", "sequence")


def _sub_keys(sub: str | None) -> list[str]:
    return [sub] if sub else []


def first_of_generations(hashed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _gen, ARRIVAL_ORDER): the first frame of each hash in each generation. Of the frames only these columns are read;
    the aggregation is partial, so a hot hash is a row a generation and task before the shuffle."""
    first = hashed.groupBy(*keys, "_gen").agg(F.min(F.struct(*ARRIVAL_ORDER)).alias("_first"))
    return first.select(*keys, "_gen", "_first.*")


def admitted_generations(firsts: DataFrame, keys: Sequence[str], gen: str = "_gen") -> DataFrame:
    """Per key, the generations that the two-generation rule admits.

    Generations holding the key form runs of consecutive integers; a run's first generation is admitted and then every second one, so
    parity with the run's start decides. Starts come from a bucketed scan: a hash that is in every generation is no single task.
    """
    ranked = run_starts(materialize(firsts, "dedup-firsts"), list(keys), gen, "_run_start")
    return ranked.filter((F.col(gen) - F.col("_run_start")) % 2 == 0).drop("_run_start")


def _only(frames: DataFrame, admitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The admitted frames whole, by semi-join on their narrow rows; a frame captured twice is one frame."""
    on = [*keys, *ARRIVAL_ORDER]
    return frames.join(admitted.select(*on), on, "left_semi").dropDuplicates(on)


def dedup_aligned(frames: DataFrame, window_s: int, sub: str | None = None) -> DataFrame:
    """Two-generation dedup with generations aligned to ``floor(ms / W)``."""
    w_ms = int(window_s) * 1000
    keys = [*_sub_keys(sub), "content_hash"]
    cols = frames.columns
    hashed = frames.filter(F.col("content_hash").isNotNull())
    ids = hashed.select(*keys, *ARRIVAL_ORDER, F.floor(F.col("received_at_ms") / F.lit(w_ms)).cast("long").alias("_gen"))
    admitted = admitted_generations(first_of_generations(ids, keys), keys)
    passthrough = frames.filter(F.col("content_hash").isNull())
    return _only(hashed, admitted, keys).select(*cols).unionByName(passthrough.select(*cols))


def dedup_first(frames: DataFrame) -> DataFrame:
    """D4 (batch): first copy of each hash over the whole table; no hash passes."""
    hashed = frames.filter(F.col("content_hash").isNotNull())
    cols = frames.columns
    first = hashed.groupBy("content_hash").agg(F.min(F.struct(*ARRIVAL_ORDER)).alias("_first")).select("content_hash", "_first.*")
    return _only(hashed, first, ["content_hash"]).select(*cols).unionByName(frames.filter(F.col("content_hash").isNull()))


def duplicate_report(frames: DataFrame, window_s: int | None = None) -> DataFrame:
    """Per hash, copies, distinct sources, first and last seen.

    With ``window_s`` a row for each burst of a hash instead, numbered from 0 in ``burst``: a copy belongs to the burst of the copy before it if
    it came less than the window after it, else it begins one. A hot hash is cut into buckets of time, as any ordered scan."""
    hashed, keys = frames.filter(F.col("content_hash").isNotNull()), ["content_hash"]
    if window_s is not None:
        seen = hashed.select("content_hash", "source", "received_at_ms")
        behind = ordered_scan(seen, keys, "received_at_ms", ["source"], lag=["received_at_ms"], lag_prefix="_prev_", rows_per_bucket=ROWS_PER_BUCKET)
        begins = F.col("received_at_ms") - F.col("_prev_received_at_ms") >= int(window_s) * 1000
        marked = materialize(behind.withColumn("_begins", F.coalesce(begins, F.lit(False)).cast("int")), "duplicate-bursts")
        hashed = ordered_scan(marked, keys, "received_at_ms", ["source"], running_sum={"burst": F.col("_begins")}, rows_per_bucket=ROWS_PER_BUCKET)
        hashed, keys = hashed.withColumn("burst", F.col("burst").cast("long")), ["content_hash", "burst"]
    return (
        hashed.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.count_distinct("source").alias("sources"),
            F.min("received_at_ms").alias("first_seen_ms"),
            F.max("received_at_ms").alias("last_seen_ms"),
        )
    )


def dedup_replay(
    frames: DataFrame, window_s: int, origin_ms: int | None = None, sub: str | None = None
) -> DataFrame:
    """The relay's two-generation dedup, generations rotated by arrivals.

    The origin is the subscription start (``origin_ms``), by default the first
    hashed arrival of each subscription; earlier frames are not part of it. Only
    hashed frames drive rotation (run after source and type filters).
    """
    w_ms = int(window_s) * 1000
    subk = _sub_keys(sub)
    cols = frames.columns
    f = frames if origin_ms is None else frames.filter(F.col("received_at_ms") >= origin_ms)
    hashed = f.filter(F.col("content_hash").isNotNull())
    arrivals = hashed.select(*subk, "received_at_ms").distinct()
    if origin_ms is None and subk:
        # one origin per subscription (a small table: one row each)
        first = hashed.groupBy(*subk).agg(F.min("received_at_ms").alias("_origin"))
        arrivals = arrivals.join(first, subk)
    else:
        if origin_ms is None:
            origin_ms = hashed.agg(F.min("received_at_ms").alias("o")).first()["o"]
            if origin_ms is None:
                return frames.select(*cols)
        arrivals = arrivals.withColumn("_origin", F.lit(int(origin_ms)))
    gens = rotation_generations(arrivals, subk, w_ms)
    keys = [*subk, "content_hash"]
    ids = hashed.select(*keys, *ARRIVAL_ORDER).join(gens, [*subk, "received_at_ms"])
    admitted = admitted_generations(first_of_generations(ids, keys), keys)
    return _only(hashed, admitted, keys).select(*cols).unionByName(f.filter(F.col("content_hash").isNull()).select(*cols))
