"""Output forms (S6 JSON lines, S7 emit, S10 telemetry messages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshframes.functions.payload import json_string
from meshframes.sources.envelope import envelope


def json_line(source="source", sequence="sequence", ts="received_at_ms", kind="kind", encoding="encoding",
              payload_text="payload_text") -> Column:
    """S6 for one frame: the projection object as compact JSON text.

    Key order source, sequence, timestamp_ms, kind, encoding, payload. A ``json``
    payload is embedded verbatim (its original text, outer whitespace cut); other
    payloads are JSON strings.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    enc = c(encoding)
    payload = F.when(enc == "json", c(payload_text)).otherwise(json_string(c(payload_text)))
    return F.concat(
        F.lit('{"source":'),
        json_string(c(source)),
        F.lit(',"sequence":'),
        c(sequence).cast("string"),
        F.lit(',"timestamp_ms":'),
        c(ts).cast("string"),
        F.lit(',"kind":'),
        c(kind).cast("string"),
        F.lit(',"encoding":'),
        json_string(enc),
        F.lit(',"payload":'),
        payload,
        F.lit("}"),
    )


def to_json_lines(frames: DataFrame) -> DataFrame:
    """One JSON text per frame (frames without a projection are skipped)."""
    return frames.filter(F.col("encoding").isNotNull()).select(
        "source", "sequence", json_line().alias("message")
    )


def write_json_lines(frames: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_json_lines(frames).select("message").write.mode(mode).text(path)


def emit(frames: DataFrame, binary: bool = False, program=None) -> DataFrame:
    """Program outputs (always JSON) win over ``binary``; else the envelope bytes;
    else JSON lines. Output columns: source, sequence, and ``message`` (string) or
    ``envelope`` (binary)."""
    if program is not None:
        from meshframes.operators.program import run_program

        return run_program(frames, program)
    if binary:
        return frames.select(
            "source", "sequence", envelope("source", "sequence", "received_at_ms", "kind", "payload").alias("envelope")
        )
    return to_json_lines(frames)


def telemetry_messages(snapshots: DataFrame, struct_cols=None) -> DataFrame:
    """One JSON message per snapshot tick; missing values (connected seconds, packet age) are written as null."""
    cols = struct_cols or [c for c in snapshots.columns if c != "at_ms"]
    return snapshots.select("at_ms", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("message"))


def write_telemetry(snapshots: DataFrame, path: str, struct_cols=None, mode: str = "append") -> None:
    """S10 sink: snapshot messages appended as JSON text files (one per tick)."""
    telemetry_messages(snapshots, struct_cols).select("message").write.mode(mode).text(path)


def latest_message(messages: DataFrame) -> DataFrame:
    """The message a new telemetry reader gets first: the latest one."""
    return messages.agg(F.max("at_ms").alias("at_ms"), F.max_by("message", "at_ms").alias("message"))
