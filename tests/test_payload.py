"""Envelope bytes, JSON projection, encodings and packet metadata on own frames."""

import base64
import json
import struct

import pytest
from pyspark.sql import functions as F

from meshframes.functions.payload import json_string
from meshframes.sources.envelope import decode_envelopes, envelope, to_capture
from meshframes.sources.frames import decode_frames
from meshframes.sources.output import to_json_lines

SCHEMA = "source string, sequence long, received_at_ms long, kind tinyint, payload binary"


def _table(spark, rows):
    return spark.createDataFrame([(s, n, t, k, bytearray(p)) for s, n, t, k, p in rows], SCHEMA)


def _record(source, sequence, ms, kind, payload):
    """The layout written out by hand."""
    s = source.encode()
    return b"CSR1" + struct.pack(">BHqqI", kind, len(s), sequence, ms, len(payload)) + s + payload


def _messages(spark, rows):
    return [r["message"] for r in to_json_lines(decode_frames(_table(spark, rows))).orderBy("sequence").collect()]


ROWS = [
    ("north", 0, 0, 1, b"[]"), ("süd-ö", 2**62, 1_999_999_999_999, 2, bytes(range(256))), ("x" * 300, 41, 5, 1, b""), ("w", 2**63 - 1, 2**40, 2, b"\0"),
]


def test_envelopes_match_the_layout(spark):
    got = _table(spark, ROWS).select("sequence", envelope("source", "sequence", "received_at_ms", "kind", "payload").alias("e")).collect()
    magic = bytes(got[0]["e"])[:4]
    for r, row in zip(got, ROWS):
        assert bytes(r["e"]) == magic + _record(*row)[4:]
    back = decode_envelopes(to_capture(_table(spark, ROWS))).collect()
    assert [(r["source"], r["sequence"], r["received_at_ms"], r["kind"], bytes(r["payload"])) for r in back] == ROWS
    assert all(r["reason"] is None and not r["trailing_bytes"] for r in back)


def test_a_source_id_too_long_for_its_field_fails_the_write(spark):
    ok = _table(spark, [("y" * 65_535, 1, 1, 1, b"1")])
    assert decode_envelopes(to_capture(ok)).first()["reason"] is None
    with pytest.raises(Exception, match="70000"):
        to_capture(_table(spark, [("y" * 70_000, 1, 1, 1, b"1")])).collect()


def test_damaged_envelopes_are_named(spark):
    good = bytes(to_capture(_table(spark, [("east", 12, 99, 1, b"{}")])).first()["envelope"])
    cases = [
        (good[:5], "short"), (b"\0\0\0\0" + good[4:], "bad_magic"), (good[:-1], "truncated"), (good[:27] + b"\xf0" + good[28:], "bad_source_utf8"),
        (good[:7] + b"\x80" + good[8:], "sequence_range"), (good, None), (good + b"!", None),
    ]
    out = decode_envelopes(spark.createDataFrame([(bytearray(b),) for b, _ in cases], "envelope binary")).collect()
    assert [r["reason"] for r in out] == [w for _, w in cases]
    assert [bool(r["trailing_bytes"]) for r in out[-2:]] == [False, True]
    assert all(r["source"] is None for r in out[:5])


def test_encodings(spark):
    cases = [
        (1, b'{"k":[true,null]}', "json"), (1, b"\n [1.50e3 ]\t", "json"), (1, b'"quoted"', "json"), (1, b"-0", "json"), (1, b"ping", "utf8"), (1, b"", "utf8"),
        (1, b"1 2", "utf8"), (1, b"[1]]", "utf8"), (1, b'{"k":1},', "utf8"), (1, b"{'k':1}", "utf8"), (1, "žluťoučký".encode(), "utf8"), (1, b"\x80abc", "base64"),
        (2, b'{"k":1}', "base64"), (2, b"", "base64"), (2, bytes(200), "base64"),
    ]
    rows = [("s", i, 10, k, p) for i, (k, p, _) in enumerate(cases)]
    for (kind, raw, want), message in zip(cases, _messages(spark, rows)):
        v = json.loads(message)
        assert list(v) == ["source", "sequence", "timestamp_ms", "kind", "encoding", "payload"]
        assert v["encoding"] == want, raw
        assert v["payload"] == (json.loads(raw) if want == "json" else raw.decode() if want == "utf8" else base64.b64encode(raw).decode())


def test_json_payloads_stay_as_written(spark):
    message = _messages(spark, [("q", 3, 4, 1, b'\r\n{ "z" : 1.0, "a":\t"\\u00e9" } ')])[0]
    assert message == '{"source":"q","sequence":3,"timestamp_ms":4,"kind":1,"encoding":"json","payload":{ "z" : 1.0, "a":\t"\\u00e9" }}'


TEXTS = ["a\u0085b", "line sep end", "".join(map(chr, range(32))), "tab\tquote\"back\\slash", "\\u001F is not an escape\x1f", "\x7f\u0080", "\U0001f600/", "[x]", ""]


def test_strings_are_escaped_like_a_strict_serializer(spark):
    short = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}
    want = lambda t: '"' + "".join(short.get(c, f"\\u{ord(c):04x}" if ord(c) < 32 else c) for c in t) + '"'
    messages = _messages(spark, [("s" + t, i, 7, 1, t.encode()) for i, t in enumerate(TEXTS)])
    for t, message in zip(TEXTS, messages):
        assert message.endswith(',"payload":' + want(t) + "}"), t
        assert message.startswith('{"source":' + want("s" + t) + ",")
        assert json.loads(message)["payload"] == t


def test_packet_metadata(spark):
    cases = [
        ('{"data":{"decoded":{"header":{"payloadTypeName":"Trace"}},"hash":"0f"}}', "TRACE", "0f"), ('{"data":{"hash":"é"},"more":[1]}', None, "é"),
        ('{"data":{"decoded":{"header":{"payloadTypeName":"größe"}}}}', "GRößE", None), ('{"data":{"decoded":{},"hash":""}}', None, None), ('{"data":{"decoded":{"header":null},"hash":"h"}}', None, "h"),
        ('{"kind":"other"}', None, None), ('{"data":[]}', None, None), ('{"data":{"hash":{"a":1}}}', None, None), ('{"data":{"hash":"h","decoded":[1]}}', None, None),
        ('{"data":{"hash":"h","decoded":{"header":"x"}}}', None, None), ('{"data":{"hash":"h","decoded":{"header":{"payloadTypeName":null}}}}', None, "h"), ('"data"', None, None),
        ('{"data":{"hash":"h"}}]', None, None),
        # a probed key that stands twice leaves no metadata, wherever it stands; others may
        ('{"data":{"hash":"a","hash":"b"}}', None, None), ('{"data":{"hash":"a"},"data":{"hash":"a"}}', None, None), ('{"data":{"hash":"a","decoded":{"header":{},"header":{}}}}', None, None),
        ('{"data":{"hash":"a","decoded":{"header":{"payloadTypeName":"X","payloadTypeName":"X"}}}}', None, None), ('{"data":{"hash":"a","h\\u0061sh":"b"}}', None, None),
        ('{"data":{"hash":"a","x":1,"x":2,"extra":{"hash":"b","data":"hash"}}}', None, "a"),
    ]
    frames = decode_frames(_table(spark, [("m", i, i, 1, t.encode()) for i, (t, _, _) in enumerate(cases)] + [("m", 99, 0, 2, cases[0][0].encode())]))
    got = {r["sequence"]: (r["payload_type"], r["content_hash"]) for r in frames.collect()}
    for i, (text, kind, content) in enumerate(cases):
        assert got[i] == (kind, content), text
    assert got[99] == (None, None)


def test_json_strings_as_the_standard_library_writes_them(spark):
    texts = [a + b + c for a in ("", "\\", "\\\\", "\\u000B", 'x"') for b in ("", "\x0b", "\x1f\x1a", "\x0e\x0f", "\x00\x07", " é\U0001f600") for c in ("", "\\u001F", "\\", "\x7f\b\t\n\f\r")]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string("t").alias("j")).collect()
    assert {r.t: r.j for r in got} == {t: json.dumps(t, ensure_ascii=False) for t in texts}
