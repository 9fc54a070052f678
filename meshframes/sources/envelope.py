"""Binary envelope (S3 write, S4 read).

Layout, big-endian: magic[4] kind[1] source_len[2] sequence[8] timestamp_ms[8]
payload_len[4] source payload. Fixed-width integers are written as zero-padded hex
and read back with ``conv``; no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meshframes.schema import ENVELOPE_HEADER_LEN, ENVELOPE_MAGIC


def _be(n: Column, width_bytes: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width_bytes, "0"))


#: Fixed widths of the length fields.
MAX_SOURCE_BYTES = 0xFFFF


def envelope(source, sequence, received_at_ms, kind, payload) -> Column:
    """S3 for one row: the envelope bytes. A source id too long for its length field fails the write."""
    src = F.col(source) if isinstance(source, str) else source
    pay = F.col(payload) if isinstance(payload, str) else payload
    src_bytes = src.cast("binary")
    whole = F.concat(
        F.lit(ENVELOPE_MAGIC).cast("binary"),
        _be(F.col(kind) if isinstance(kind, str) else kind, 1),
        _be(F.octet_length(src_bytes), 2),
        _be(F.col(sequence) if isinstance(sequence, str) else sequence, 8),
        _be(F.col(received_at_ms) if isinstance(received_at_ms, str) else received_at_ms, 8),
        _be(F.octet_length(pay), 4),
        src_bytes,
        pay,
    )
    too_long = F.raise_error(F.concat(F.lit("source id of "), F.octet_length(src_bytes).cast("string"), F.lit(" bytes"))).cast("binary")
    return F.when(F.octet_length(src_bytes) > MAX_SOURCE_BYTES, too_long).otherwise(whole)


def to_capture(frames: DataFrame, keep=()) -> DataFrame:
    """Frames to the ``capture(envelope)`` table (``keep``: pass-through columns)."""
    return frames.select(*keep, envelope("source", "sequence", "received_at_ms", "kind", "payload").alias("envelope"))


def write_capture(frames: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S3: write frames as envelope records (parquet, one binary column)."""
    to_capture(frames).write.mode(mode).parquet(path)


def _uint(b: Column, pos: int, width: int) -> Column:
    # unsigned big-endian integer from bytes [pos, pos+width) (1-based pos)
    return F.conv(F.hex(F.substring(b, pos, width)), 16, 10)


def decode_envelopes(capture: DataFrame, col: str = "envelope") -> DataFrame:
    """S4 core: every record decoded, with ``reason`` null for good rows.

    Reasons: ``short`` (under 27 bytes), ``bad_magic``, ``truncated`` (lengths run
    past the record), ``bad_source_utf8``, ``sequence_range`` / ``timestamp_range``
    (above 2^63-1). Trailing bytes after the payload are allowed and flagged.
    """
    env = F.col(col)
    n = F.octet_length(env)
    header = F.substring(env, 1, ENVELOPE_HEADER_LEN)
    magic_ok = F.substring(env, 1, 4) == F.lit(ENVELOPE_MAGIC).cast("binary")
    kind = _uint(header, 5, 1).cast("int")
    source_len = _uint(header, 6, 2).cast("int")
    sequence = _uint(header, 8, 8).cast("decimal(20,0)")
    ts = _uint(header, 16, 8).cast("decimal(20,0)")
    payload_len = _uint(header, 24, 4).cast("long")
    end = F.lit(ENVELOPE_HEADER_LEN) + source_len.cast("long") + payload_len
    src_raw = F.substring(env, ENVELOPE_HEADER_LEN + 1, source_len)
    source = F.try_validate_utf8(src_raw.cast("string"))
    payload = F.substring(env, F.lit(ENVELOPE_HEADER_LEN + 1) + source_len, payload_len.cast("int"))
    max_long = F.lit(9223372036854775807).cast("decimal(20,0)")
    reason = (
        F.when(n < ENVELOPE_HEADER_LEN, F.lit("short"))
        .when(~magic_ok, F.lit("bad_magic"))
        .when(n < end, F.lit("truncated"))
        .when(source.isNull(), F.lit("bad_source_utf8"))
        .when(sequence > max_long, F.lit("sequence_range"))
        .when(ts > max_long, F.lit("timestamp_range"))
    )
    good = reason.isNull()
    return capture.select(
        *[F.col(c) for c in capture.columns],
        reason.alias("reason"),
        F.when(good, source).alias("source"),
        F.when(good, sequence.cast("long")).alias("sequence"),
        F.when(good, ts.cast("long")).alias("received_at_ms"),
        F.when(good, kind.cast("tinyint")).alias("kind"),
        F.when(good, payload).alias("payload"),
        F.when(good, n > end).alias("trailing_bytes"),
    )


def read_capture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Envelope records to ``(frames, quarantine)``.

    Both outputs come from one decoded plan; write or checkpoint it if both are
    consumed, so the file is not decoded twice.
    """
    dec = decode_envelopes(spark.read.parquet(path))
    return split_decoded(dec)


def split_decoded(dec: DataFrame, col: str = "envelope") -> tuple[DataFrame, DataFrame]:
    decoded = ("reason", "source", "sequence", "received_at_ms", "kind", "payload", "trailing_bytes")
    extra = [c for c in dec.columns if c not in decoded and c != col]
    frames = dec.filter(F.col("reason").isNull()).select(
        *extra, "source", "sequence", "received_at_ms", "kind", "payload", "trailing_bytes"
    )
    quarantine = dec.filter(F.col("reason").isNotNull()).select(*extra, col, "reason")
    return frames, quarantine
