"""Frame and catalog filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F



class UnknownSourcesError(ValueError):
    def __init__(self, unknown: Sequence[str]):
        self.unknown = list(unknown)
        super().__init__("unknown source(s): " + ", ".join(self.unknown))


def requested_ids(sources: Sequence[str] = (), sources_csv: str | None = None) -> list[str]:
    """Repeated ``source`` values, then the comma list (trimmed, blanks dropped);
    repeats removed keeping the first."""
    ids = list(sources)
    if sources_csv is not None:
        ids.extend(p.strip() for p in sources_csv.split(",") if p.strip())
    seen: set[str] = set()
    return [i for i in ids if not (i in seen or seen.add(i))]


def requested_types(csv: str | None) -> list[str] | None:
    """Upper-cased payload types; None when no filter was asked for."""
    if csv is None:
        return None
    types = []
    for part in csv.split(","):
        p = part.strip()
        if p:
            t = "".join(ch.upper() if "a" <= ch <= "z" else ch for ch in p)
            if t not in types:
                types.append(t)
    return types or None


def unknown_ids(ids: Sequence[str], sources: DataFrame) -> list[str]:
    """Requested ids absent from the catalog, in request order (driver-side check on
    the requested list only; the catalog is scanned with a semi-join)."""
    if not ids:
        return []
    spark = sources.sparkSession
    req = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, pos int")
    missing = req.join(sources.select("id"), "id", "left_anti").orderBy("pos").collect()
    return [r["id"] for r in missing]


def filter_sources(frames: DataFrame, ids: Sequence[str], sources: DataFrame | None = None) -> DataFrame:
    """keep frames of the listed sources; empty list = no filter.

    Unknown ids raise naming all of them, checked before any frame is read. The list is a
    table and the filter a semi join, however many ids there are; AQE picks the strategy.
    """
    ids = list(ids)
    if not ids:
        return frames
    if sources is not None:
        missing = unknown_ids(ids, sources)
        if missing:
            raise UnknownSourcesError(missing)
    spark = frames.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], "source string")
    return frames.join(wanted, "source", "left_semi")


def filter_payload_types(frames: DataFrame, csv: str | None) -> DataFrame:
    """keep listed payload types (any case); blank list = no filter; frames
    without a type drop."""
    types = requested_types(csv)
    if types is None:
        return frames
    return frames.filter(F.col("payload_type").isin(types))


def filter_source_pattern(df: DataFrame, regex: str, col: str = "source") -> DataFrame:
    """fully anchored regular expression on a label (multi-value as ``a|b``)."""
    return df.filter(F.col(col).rlike(rf"\A(?:{regex})\z"))


def drop_disabled(frames: DataFrame, sources: DataFrame) -> DataFrame:
    """frames of enabled catalog sources only (disabled ones stay listed)."""
    enabled = sources.filter(~F.coalesce(F.col("disabled"), F.lit(False))).select(F.col("id").alias("source"))
    return frames.join(enabled, "source", "left_semi")

