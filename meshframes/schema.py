"""Table schemas, fixed constants and argument records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the relay's for identical results.
# ---------------------------------------------------------------------------
# Envelope: magic text, header length in bytes (magic 4, kind 1, source length 2,
# sequence 8, timestamp 8, payload length 4), all integers big-endian.
ENVELOPE_MAGIC = "CSR1"
ENVELOPE_HEADER_LEN = 27
# Frame kinds.
KIND_TEXT = 1
KIND_BINARY = 2
# Connection states, in code order 0..7; an unknown code reads as "disconnected".
STATE_NAMES = (
    "disabled",
    "disconnected",
    "connecting",
    "handshaking",
    "connected",
    "reconnect_wait",
    "reconnect_wait_degraded",
    "stopping",
)
UNKNOWN_STATE = "disconnected"
# Status page labels that differ from the state name.
STATE_LABELS = {"reconnect_wait": "retrying", "reconnect_wait_degraded": "degraded"}
# Truthy spellings of a flag argument (after trim and lower-case); absent is false.
TRUE_FLAGS = ("", "1", "true", "yes", "on")
# Telemetry: CPU averaged over the last 5 samples; elapsed floor 0.001 s.
CPU_WINDOW_SAMPLES = 5
MIN_ELAPSED_S = 0.001
# Status log interval used as a nominal divisor (seconds).
STATUS_INTERVAL_S = 10.0
# Status page: 30 history points, bar height 26, minimum visible bar 2, empty bar 1.
HISTORY_LEN = 30
SPARK_HEIGHT = 26.0
# Idle levels (seconds since last packet): warn from 60, bad from 300.
IDLE_WARN_S = 60
IDLE_BAD_S = 300
# Increase levels for reconnects / errors over 1 h: orange from 1, red from 10.
INCREASE_ORANGE = 1
INCREASE_RED = 10
# Source id limit in bytes (u16 length field).
MAX_SOURCE_ID_BYTES = 65535


@dataclass(frozen=True)
class DedupPolicy:
    default_window_s: int = 300
    max_window_s: int = 3600


@dataclass(frozen=True)
class ReconnectPolicy:
    # relay defaults: 1 s initial, 30 s max, degraded after 60 s offline, then 300 s
    initial_delay_s: float = 1.0
    max_delay_s: float = 30.0
    offline_threshold_s: float = 60.0
    offline_delay_s: float = 300.0


@dataclass(frozen=True)
class RelaySettings:
    channel_capacity: int = 4096
    user_agent: str = "meshframes"
    reconnect: ReconnectPolicy = field(default_factory=ReconnectPolicy)
    dedup: DedupPolicy = field(default_factory=DedupPolicy)


@dataclass(frozen=True)
class Subscription:
    """Arguments of one subscriber, applied in a fixed order by ``subscribe``."""

    sources: tuple[str, ...] = ()
    sources_csv: str | None = None
    payload_types: str | None = None
    dedup_by_content: bool = False
    dedup_window_s: int | None = None
    program: object | None = None  # a Program from operators.program, or None
    binary: bool = False


RAW_FRAME = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("received_at_ms", T.LongType(), False),
        T.StructField("kind", T.ByteType(), False),
        T.StructField("payload", T.BinaryType(), True),
    ]
)

FRAMES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("received_at_ms", T.LongType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("kind", T.ByteType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("payload_text", T.StringType()),
        T.StructField("payload_v", T.VariantType()),
        T.StructField("payload_type", T.StringType()),
        T.StructField("content_hash", T.StringType()),
    ]
)

CAPTURE = T.StructType([T.StructField("envelope", T.BinaryType())])

SOURCES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("disabled", T.BooleanType()),
        T.StructField("proxy", T.StringType()),
        T.StructField("mapping", T.StringType()),
    ]
)

CONN_EVENTS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("at_ms", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

COUNTERS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("at_ms", T.LongType()),
        T.StructField("packets", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("reconnects", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("connected", T.ByteType()),
        T.StructField("last_packet_ms", T.LongType()),
    ]
)

PROCESS_SAMPLES = T.StructType(
    [
        T.StructField("instance", T.StringType()),
        T.StructField("at_ms", T.LongType()),
        T.StructField("cpu_seconds", T.DoubleType()),
        T.StructField("rss_bytes", T.LongType()),
        T.StructField("open_fds", T.LongType()),
        T.StructField("max_fds", T.LongType()),
        T.StructField("start_time_s", T.DoubleType()),
    ]
)

SUBSCRIPTION_EVENTS = T.StructType(
    [
        T.StructField("subscription_id", T.StringType()),
        T.StructField("at_ms", T.LongType()),
        T.StructField("opened", T.BooleanType()),
        T.StructField("source", T.StringType()),
    ]
)

ANALYZER = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    ]
)

NETWORKS = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("analyzers", T.ArrayType(ANALYZER)),
    ]
)
