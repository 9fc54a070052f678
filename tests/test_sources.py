"""Ingest and sinks: per-source union (S1), stamping (S2), catalog file (S8),
telemetry messages (S10), write/read capture round trip (S3 S4)."""

import json

from pyspark.sql import functions as F

from meshframes.operators.catalog import read_sources
from meshframes.session import scratch_path
from meshframes.sources import envelope as env
from meshframes.sources.frames import build_frames_table, read_frames, stamp_frames
from meshframes.sources.output import latest_message, telemetry_messages, write_telemetry

RAW = "received_at_ms long, kind tinyint, payload binary, arrival long"


def test_read_frames_unions_sources_and_stamps(spark):
    paths = {}
    for sid, rows in {"a": [(5, 1, bytearray(b'{"x":1}'), 0), (1, 2, bytearray(b"\x00"), 1)],
                      "b": [(3, 1, bytearray(b"hi"), 2)]}.items():
        p = scratch_path(spark, f"raw-{sid}")
        spark.createDataFrame(rows, RAW).write.parquet(p)
        paths[sid] = p
    raw = read_frames(spark, paths)
    got = sorted((r["source"], r["received_at_ms"], r["sequence"], r["payload_bytes"])
                 for r in stamp_frames(raw, tiebreak=["arrival"]).collect())
    assert got == [("a", 1, 0, 1), ("a", 5, 1, 7), ("b", 3, 0, 2)]
    table = build_frames_table(raw, scratch_path(spark, "frames-table"), tiebreak=["arrival"])
    enc = {(r["source"], r["sequence"]): r["encoding"] for r in table.collect()}
    assert enc == {("a", 0): "base64", ("a", 1): "json", ("b", 0): "utf8"}


def test_capture_round_trip_is_identity(spark):
    rows = [("src-%d" % (i % 3), i, 1_700_000_000_000 + i, 1 + i % 2, bytearray(("p%d" % i).encode() * (i % 5)))
            for i in range(50)]
    f = spark.createDataFrame(rows, "source string, sequence long, received_at_ms long, kind tinyint, payload binary")
    path = scratch_path(spark, "capture-test")
    env.write_capture(f, path)
    good, bad = env.read_capture(spark, path)
    assert bad.count() == 0
    back = good.drop("trailing_bytes")
    assert back.exceptAll(f).count() == 0 and f.exceptAll(back).count() == 0


def test_read_sources_defaults(spark):
    p = scratch_path(spark, "sources-json")
    lines = [{"id": "prague", "url": "wss://a/ws"}, {"id": "plzen", "url": "wss://b/ws", "headers": {"Authorization": "x"}},
             {"id": "off", "url": "wss://c/ws", "disabled": True, "proxy": "http://p:1", "mapping": "net:0"}]
    spark.createDataFrame([(json.dumps(x),) for x in lines], "value string").write.text(p)
    got = {r["id"]: (r["headers"], r["disabled"], r["proxy"], r["mapping"]) for r in read_sources(spark, p).collect()}
    assert got == {"prague": ({}, False, None, None), "plzen": ({"Authorization": "x"}, False, None, None),
                   "off": ({}, True, "http://p:1", "net:0")}


def test_telemetry_messages_and_latest(spark):
    snaps = spark.createDataFrame([(1000, 1.5, 3), (2000, 2.0, 4)], "at_ms long, pps double, clients long")
    msgs = telemetry_messages(snaps)
    latest = latest_message(msgs).first()
    assert latest["at_ms"] == 2000 and json.loads(latest["message"]) == {"pps": 2.0, "clients": 4}
    p = scratch_path(spark, "telemetry")
    write_telemetry(snaps, p)
    assert sorted(json.loads(r["value"])["clients"] for r in spark.read.text(p).collect()) == [3, 4]


def test_control_messages_are_not_frames(spark):
    from meshframes.sources.frames import drop_control

    df = spark.createDataFrame([(1,), (2,), (9,), (0,)], "kind int")
    assert sorted(r["kind"] for r in drop_control(df).collect()) == [1, 2]
