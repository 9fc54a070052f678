"""one subscriber's view of the frames table.

Filters apply in the relay's fixed order: source, payload type, content dedup,
program, output form. Filters that were not asked for are not added to the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from meshframes.operators import dedup as dd
from meshframes.operators import filters as flt
from meshframes.schema import DedupPolicy, Subscription
from meshframes.sources.output import emit


def dedup_window_s(sub: Subscription, policy: DedupPolicy = DedupPolicy()) -> int | None:
    """P12 on driver-side arguments: the window in seconds, or None when off."""
    if not sub.dedup_by_content:
        return None
    mx = max(policy.max_window_s, 1)
    default = min(max(policy.default_window_s, 1), mx)
    if sub.dedup_window_s is None:
        return default
    return min(max(sub.dedup_window_s, 1), mx)


def subscribe(
    frames: DataFrame,
    sub: Subscription,
    sources: DataFrame | None = None,
    policy: DedupPolicy = DedupPolicy(),
    dedup_mode: str = "replay",
    origin_ms: int | None = None,
) -> DataFrame:
    """Frames as one subscriber receives them (see module doc).

    ``dedup_mode``: ``replay`` (D1, generations rotated by arrivals from ``origin_ms``, as the relay
    does) or ``aligned`` (D2, generations at multiples of W).
    """
    f = frames
    if origin_ms is not None:
        f = f.filter(f["received_at_ms"] >= origin_ms)
    f = flt.filter_sources(f, flt.requested_ids(sub.sources, sub.sources_csv), sources)
    f = flt.filter_payload_types(f, sub.payload_types)
    w = dedup_window_s(sub, policy)
    if w is not None:
        if dedup_mode == "replay":
            f = dd.dedup_replay(f, w, origin_ms=origin_ms)
        else:
            f = dd.dedup_aligned(f, w)
    return emit(f, binary=sub.binary, program=sub.program)
