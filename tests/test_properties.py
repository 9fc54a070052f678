"""Property tests (hypothesis): envelope round trip, strict JSON, dedup invariants."""

import json

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from meshframes.operators.dedup import dedup_aligned
from meshframes.sources.envelope import decode_envelopes, to_capture
from meshframes.sources.frames import decode_frames

FR = "source string, sequence long, received_at_ms long, kind tinyint, payload binary"
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

frame = st.tuples(
    st.text(min_size=1, max_size=12),
    st.integers(min_value=0, max_value=2**63 - 1),
    st.integers(min_value=0, max_value=2**63 - 1),
    st.integers(min_value=0, max_value=127),
    st.binary(max_size=64),
)


@SLOW
@given(st.lists(frame, min_size=1, max_size=20))
def test_envelope_round_trip(spark, rows):
    df = spark.createDataFrame([(s, q, t, k, bytearray(p)) for s, q, t, k, p in rows], FR)
    back = decode_envelopes(to_capture(df))
    assert back.filter(F.col("reason").isNotNull()).count() == 0
    got = back.select("source", "sequence", "received_at_ms", "kind", "payload")
    assert got.exceptAll(df).count() == 0 and df.exceptAll(got).count() == 0


json_value = st.recursive(
    st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=5), inner, max_size=3),
    max_leaves=8,
)


@SLOW
@given(st.lists(json_value, min_size=1, max_size=10), st.sampled_from(["", " x", "}", ",1", "  "]))
def test_json_encoding_matches_python_parser(spark, values, suffix):
    texts = [json.dumps(v) + suffix for v in values]
    df = spark.createDataFrame([("s", i, i, 1, bytearray(t.encode())) for i, t in enumerate(texts)], FR)
    got = {r["sequence"]: r["encoding"] for r in decode_frames(df).collect()}
    for i, t in enumerate(texts):
        try:
            json.loads(t)
            want = "json"
        except ValueError:
            want = "utf8"
        assert got[i] == want, t


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 20_000)), min_size=1, max_size=40),
       st.integers(1, 5))
def test_aligned_dedup_matches_greedy(spark, rows, window_s):
    df = spark.createDataFrame([("s", i, ms, h) for i, (h, ms) in enumerate(rows)],
                               "source string, sequence long, received_at_ms long, content_hash string")
    got = sorted(r["sequence"] for r in dedup_aligned(df, window_s).collect())
    w = window_s * 1000
    last, want = {}, []
    for i, (h, ms) in sorted(enumerate(rows), key=lambda x: (x[1][1], "s", x[0])):
        if h is None:
            want.append(i)
            continue
        g = ms // w
        if h not in last or g >= last[h] + 2:
            last[h] = g
            want.append(i)
    assert got == sorted(want)


@SLOW
@given(st.dictionaries(st.sampled_from(["a", "b", "c"]), st.sets(st.integers(0, 300), min_size=1, max_size=60), min_size=1))
def test_gaps_plus_present_is_range(spark, seqs):
    from meshframes.operators.windows import sequence_gaps

    rows = [(s, q) for s, qs in seqs.items() for q in qs if q != 0]
    if not rows:
        return
    df = spark.createDataFrame(rows, "source string, sequence long")
    gaps = {}
    for r in sequence_gaps(df, order="sequence", tiebreak=()).collect():
        gaps[r["source"]] = gaps.get(r["source"], 0) + r["skipped"]
    for s in {r[0] for r in rows}:
        present = sorted(q for src, q in rows if src == s)
        assert gaps.get(s, 0) + len(present) == present[-1] - present[0] + 1
