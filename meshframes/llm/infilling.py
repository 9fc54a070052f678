"""Fill-in-middle transformation: two cuts of each text, found by an indexable skip list.

A text is a sequence of units ``[white space]*[other characters]+`` (a last run of white space is a unit too; white
space is U+0020 and U+0009 to U+000D). Two ranks are drawn from a hash of the document's id; the prefix ends after the
smaller number of units, the middle after the larger. :class:`SkipList` holds the units: a unit's tower is as high as a
hash of its place says (each lane keeps about one in :data:`SPAN` towers of the lane beneath), and every link of a lane
carries its width in units and in code points (and in bytes, as the text lies in UTF-8). A search starts in the highest lane,
follows links while the accumulated unit width does not pass the rank, and goes one lane down; the code points and
bytes accumulated on the way are the cut, exactly. So a text is scanned once, and each further rank costs a descent.

:func:`transform` needs no shuffle: a row depends on itself alone, so a lost executor costs its own rows anew.

Defined results: a null text is the empty text, form plain; a null doc_id is hashed as no digits; repeated rows give equal rows;
an empty table gives no rows; bytes that are not UTF-8 are carried over by :func:`transform`
(a code point is a byte that doesn't continue one), but :func:`restored` reads UTF-8 only.
Of other columns those in ``keep`` pass, but for those named like a new column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from meshframes.llm.common import with_arrow_columns

#: Fixed values of the format: marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are cut; of 100 cut ones so many put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42
#: A lane has about one in so many of the towers of the lane beneath it.
SPAN = 16
NEW = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
]


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Byte places where units end, ascending; of no bytes none."""
    if not len(raw):
        return np.zeros(0, np.int64)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    ends = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    return np.append(ends, len(raw))


class SkipList:
    """Units of one text by rank. ``lanes[k]``: towers of at least that height, as (places in the lane beneath, widths of the link that ends at
    each: units, code points, bytes); lane 0 has every unit. A search keeps an index in its lane, as links lie in arrays."""

    def __init__(self, raw: np.ndarray) -> None:
        ends = unit_ends(raw)
        self.units = len(ends)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
        towers = np.column_stack([np.arange(1, len(ends) + 1), lead[ends], ends]).astype(np.int64)
        below = np.arange(len(ends), dtype=np.int64)
        height = self._heights(len(ends))
        self.lanes = []
        k = 0
        while True:
            self.lanes.append((below, np.diff(towers, axis=0, prepend=0)))
            k += 1
            up = np.flatnonzero(height >= k)
            if not len(up):
                break
            below, towers, height = up, towers[up], height[up]
        self.steps = 0

    @staticmethod
    def _heights(n: int) -> np.ndarray:
        """Tower heights by a hash of the place: at least k with a chance of ``SPAN ** -k``."""
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        out = np.zeros(n, np.int64)
        part = np.uint64(1)
        for _ in range(15):
            part *= np.uint64(SPAN)
            high = (x % part) == 0
            if not high.any():
                break
            out += high
        return out

    def descend(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) of the first ``rank`` units."""
        units = chars = size = 0
        at = -1  # the tower reached in the lane: before the first
        for k in range(len(self.lanes) - 1, -1, -1):
            below, widths = self.lanes[k]
            while units < rank and at + 1 < len(widths) and units + widths[at + 1, 0] <= rank:
                at += 1
                units, chars, size = units + int(widths[at, 0]), chars + int(widths[at, 1]), size + int(widths[at, 2])
                self.steps += 1
            if k:
                at = int(below[at]) if at >= 0 else -1
        return chars, size


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _cut(doc_id: int | None, text: bytes, rate: int, suffix_first: int, seed: int) -> tuple:
    raw = np.frombuffer(text, np.uint8)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return len(unit_ends(raw)), "plain", None, None, text
    units = SkipList(raw)
    first, second = sorted((h1 % (units.units + 1), h2 % (units.units + 1)))
    (c1, b1), (c2, b2) = units.descend(first), units.descend(second)
    prefix, middle, suffix = text[:b1], text[b1:b2], text[b2:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < suffix_first:
        return units.units, "spm", c1, c2 - c1, s + suffix + p + prefix + m + middle
    return units.units, "psm", c1, c2 - c1, p + prefix + s + suffix + m + middle


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id, text, ...) with n, form, prefix_chars, middle_chars and output."""

    def make():
        def run(ids: pa.Array, texts: pa.Array):
            rows = [_cut(i, t or b"", rate, suffix_first, seed) for i, t in zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist())]
            n, form, prefix, middle, out = zip(*rows) if rows else ([],) * 5
            long = pa.int64()
            # bytes that are no UTF-8 must pass, so the text is not checked again
            output = pa.array(out, pa.binary())
            output = pa.Array.from_buffers(pa.string(), len(output), output.buffers(), output.null_count, output.offset)
            return pa.array(n, long), pa.array(form, pa.string()), pa.array(prefix, long), pa.array(middle, long), output

        return run

    kept = [c for c in keep if c not in {f.name for f in NEW}]
    plain = docs.select(*kept, F.col("doc_id").cast("long").alias("_doc"), F.col("text").alias("_text"))
    return with_arrow_columns(plain, ["_doc", "_text"], NEW, make, keep=kept)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of. No text with a mark is cut and a mark begins with a sign that no mark has
    elsewhere, so the first occurrences are the marks."""
    body = F.substring(output, 4, 2**31 - 1)
    psm_rest = F.split_part(body, F.lit(SUFFIX), F.lit(2))
    psm = F.concat(F.split_part(body, F.lit(SUFFIX), F.lit(1)), F.split_part(psm_rest, F.lit(MIDDLE), F.lit(2)), F.split_part(psm_rest, F.lit(MIDDLE), F.lit(1)))
    spm_rest = F.split_part(body, F.lit(PREFIX), F.lit(2))
    spm = F.concat(F.split_part(spm_rest, F.lit(MIDDLE), F.lit(1)), F.split_part(spm_rest, F.lit(MIDDLE), F.lit(2)), F.split_part(body, F.lit(PREFIX), F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(cut: DataFrame) -> DataFrame:
    text = restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), u as (
  select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
    cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
    cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
  from d
), f as (
  select *, len(units) as n,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from u
), c as (
  select doc_id, t, n, form,
    coalesce(array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], ''), '') as p,
    coalesce(array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], ''), '') as m
  from f
), s as (
  select *, substr(t, length(p) + length(m) + 1) as x from c
)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m else '<S>' || x || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from s
"""
