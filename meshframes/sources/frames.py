"""Frame ingest: union of sources (S1), stamping (S2), decode (P1, P2), raw view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshframes.functions.payload import (
    _obj_or_null,
    _str_or_null,
    repeats_probed_key,
    base64_flat,
    encoding_of,
    strict_json_ok,
    wrap_for_strict_json,
    json_trim,
    utf8_text,
)
from meshframes.functions.scalars import ascii_upper, payload_bytes
from meshframes.operators.scan import DEFAULT_BUCKET_MS, ROWS_PER_BUCKET, ordered_scan
from meshframes.schema import KIND_TEXT


# Target frames per (source, time bucket) when stamping: a bucket is one window task.
STAMP_ROWS_PER_BUCKET = ROWS_PER_BUCKET


def read_frames(
    spark: SparkSession,
    paths_by_source: Mapping[str, str],
    fmt: str = "parquet",
    schema=None,
    streaming: bool = False,
) -> DataFrame:
    """Many captured upstreams become one frame table.

    Each path holds ``received_at_ms``, ``kind`` and ``payload`` (plus optional
    columns); the mapping key becomes ``source``. Control messages are not frames and
    are expected to be absent. One scan per source, then ``unionByName``.
    """
    reader = spark.readStream if streaming else spark.read
    parts = []
    for source_id, path in paths_by_source.items():
        r = reader.format(fmt)
        if schema is not None:
            r = r.schema(schema)
        parts.append(r.load(path).withColumn("source", F.lit(source_id)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def drop_control(frames: DataFrame) -> DataFrame:
    """Only text (1) and binary (2) messages are frames; control messages (ping,
    pong, close, any other kind) carry no data and are dropped."""
    return frames.filter(F.col("kind").isin(1, 2))


def union_frames(*tables: DataFrame) -> DataFrame:
    """S1 on already-read tables: one stream of frames, columns matched by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def stamp_frames(
    raw: DataFrame,
    tiebreak: Sequence[str] = (),
    bucket_ms: int = DEFAULT_BUCKET_MS,
    keep_tiebreak: bool = False,
    rows_per_bucket: int | None = STAMP_ROWS_PER_BUCKET,
) -> DataFrame:
    """Per-source 0-based arrival ``sequence``, ``received_at``, ``payload_bytes``.

    Arrival order is ``received_at_ms`` then ``tiebreak``. Numbering is an ordered
    scan bucketed by time with a per-source bucket width (about ``rows_per_bucket``
    frames per bucket), so one busy source is spread over many tasks however dense
    its traffic is.
    """
    out = ordered_scan(raw, ["source"], "received_at_ms", tiebreak, bucket_ms=bucket_ms, row_number="sequence",
                       rows_per_bucket=rows_per_bucket)
    out = out.withColumn("received_at", F.timestamp_millis("received_at_ms")).withColumn(
        "payload_bytes", payload_bytes("payload")
    )
    if not keep_tiebreak:
        out = out.drop(*tiebreak)
    return out


def decode_frames(frames: DataFrame) -> DataFrame:
    """P1 + P2: adds ``encoding``, ``payload_text``, ``payload_v`` (the JSON payload
    as VARIANT, parsed once), ``payload_type``, ``content_hash``.

    Computed once per frame and written with the frames table (the relay parses each
    frame once for all subscribers). Staged projections keep every intermediate
    (UTF-8 text, validity, parsed document, probed levels) a column of its own, so
    each is evaluated once and the generated code stays small.
    """
    base = frames.columns
    kind, payload = F.col("kind"), F.col("payload")
    d = frames.withColumn("_text", utf8_text(payload))
    d = d.withColumn("_wrapped", F.when(kind == F.lit(KIND_TEXT), wrap_for_strict_json(F.col("_text"))))
    d = d.withColumn("_json_ok", strict_json_ok(F.col("_wrapped"), F.col("_text")))
    d = d.withColumn("encoding", encoding_of(kind, F.col("_text").isNotNull(), F.col("_json_ok")))
    d = d.withColumn(
        "payload_text",
        F.when(F.col("encoding") == "json", json_trim(F.col("_text")))
        .when(F.col("encoding") == "utf8", F.col("_text"))
        .otherwise(base64_flat(payload)),
    )
    d = d.withColumn("payload_v", F.when(F.col("encoding") == "json", F.try_variant_get(F.col("_wrapped"), "$[0]", "variant")))
    d = with_meta_from_doc(d, "payload_v")
    twice = (F.col("encoding") == "json") & repeats_probed_key("payload_text")
    d = d.withColumn("_m_twice", twice)
    for c in ("payload_type", "content_hash"):
        d = d.withColumn(c, F.when(~F.coalesce(F.col("_m_twice"), F.lit(False)), F.col(c)))
    out = ("encoding", "payload_text", "payload_v", "payload_type", "content_hash")
    keep = [c for c in base if c not in out]
    return d.select(*keep, *out)


def build_frames_table(raw: DataFrame, path: str, tiebreak=(), mode: str = "errorifexists") -> DataFrame:
    """S2 + P1 + P2 as one job: stamp and decode raw frames and write the frames
    table (parquet) that every subscriber reads; returns the written table."""
    decode_frames(stamp_frames(raw, tiebreak=tiebreak)).write.mode(mode).parquet(path)
    return raw.sparkSession.read.parquet(path)


def with_meta_from_doc(d: DataFrame, doc: str) -> DataFrame:
    """P1 on a parsed document: ``payload_type`` = ASCII upper-case of ``data.decoded.header.payloadTypeName``, ``content_hash`` =
    ``data.hash`` with '' as null. A type mismatch on any probed level (``data`` / ``decoded`` / ``header`` not an object, a leaf not a
    string) empties both. ``doc`` must be null for non-text or invalid input."""
    d = d.withColumn("_m_data", F.try_variant_get(F.col(doc), "$.data", "struct<hash:variant,decoded:variant>"))
    d = d.withColumn("_m_dec", F.try_variant_get(F.col("_m_data.decoded"), "$", "struct<header:variant>"))
    d = d.withColumn("_m_hdr", F.try_variant_get(F.col("_m_dec.header"), "$", "struct<payloadTypeName:variant>"))
    hash_v, dec_v, hdr_v, name_v = (F.col("_m_data.hash"), F.col("_m_data.decoded"), F.col("_m_dec.header"),
                                   F.col("_m_hdr.payloadTypeName"))
    ok = (
        F.col("_m_data").isNotNull()
        & _str_or_null(hash_v)
        & _obj_or_null(dec_v, F.col("_m_dec"))
        & _obj_or_null(hdr_v, F.col("_m_hdr"))
        & _str_or_null(name_v)
    )
    d = d.withColumn("_m_ok", ok)
    d = d.withColumn("payload_type", F.when(F.col("_m_ok"), ascii_upper(F.try_variant_get(name_v, "$", "string"))))
    d = d.withColumn("content_hash", F.when(F.col("_m_ok"), F.nullif(F.try_variant_get(hash_v, "$", "string"), F.lit(""))))
    return d


def with_packet_meta(frames: DataFrame) -> DataFrame:
    """P1 alone: ``payload_type`` and ``content_hash`` from kind-1 JSON payloads."""
    return decode_frames(frames).drop("encoding", "payload_text", "payload_v")


def with_encoding(frames: DataFrame) -> DataFrame:
    """P2 alone: ``encoding`` and the projected ``payload_text``."""
    return decode_frames(frames).drop("payload_type", "content_hash", "payload_v")


class UnknownSourceError(ValueError):
    pass


def raw_source(frames: DataFrame, source_id: str, sources: DataFrame | None = None) -> DataFrame:
    """One source's frames unchanged (kind, payload), no envelope.

    An id that is not in the catalog is an error, checked on a one-row lookup.
    """
    if sources is not None:
        if sources.filter(F.col("id") == source_id).limit(1).count() == 0:
            raise UnknownSourceError(f"unknown source: {source_id}")
    return frames.filter(F.col("source") == F.lit(source_id)).select("source", "sequence", "received_at_ms", "kind", "payload")
