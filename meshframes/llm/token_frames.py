"""Token-id files of independent zstandard frames with a trailing seek table.

Layout of a file (the public seekable zstandard format; any zstandard reader can unpack it whole):

* data frames, each independent: little-endian unsigned 32-bit ids of whole documents up to about
  ``frame_ids`` ids; a longer document has frames of its own;
* a skippable frame with the document index: for each document its id and its number of ids;
* a skippable frame with the seek table: compressed size, decompressed size and checksum (the low half
  of xxh64 of the decompressed bytes) of every frame before it, then the number of frames.

A reader fetches the last bytes, then the index, then only the frames of the documents asked for.

:func:`write` range-partitions documents by (doc_id, text hash), so files in order of their numbers hold the
documents in ascending doc_id order, and writes one file a task through a file system named by the path (shared
by driver and executors); the file appears under its name only when whole, and a task that runs again writes
the same bytes. Only one row a file (name, counts) reaches the driver.

Defined results: a null text is empty (its document is the end id alone); null doc_ids come first; rows with the same
doc_id are neighbours, in the order of their texts' hashes; an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshframes.llm.common import blocks, in_tasks
from meshframes.llm.tokens import encoder

#: Fixed values of the seekable format.
SEEK_MAGIC = 0x184D2A5E
SEEK_END = 0x8F92EAB1
CHECKED = 0x80
#: A skippable frame's magic number, free for users.
INDEX_MAGIC = 0x184D2A50
NO_ID = -(1 << 63)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


class FrameWriter:
    """Appends documents to an output stream."""

    def __init__(self, out, frame_ids: int = 65_536, level: int = 3) -> None:
        self.out, self.most = out, frame_ids * 4
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.most:
            self._flush()
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids) // 4)
        for i in range(0, len(ids), self.most):
            if i:
                self._flush()
            self.held.append(ids[i : i + self.most])
            self.size += len(self.held[-1])

    def _flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        index = self.pack.compress(np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.table.append((len(index) + 8, 0, 0))
        entries = np.array(self.table, "<u4").tobytes()
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKED, SEEK_END))


class FrameReader:
    """Documents of one file; ``frames_read`` counts the frames unpacked."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.size()
        source.seek(end - 9)
        n, checked, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_END or checked != CHECKED:
            raise ValueError("the seek table is missing")
        source.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.raw = np.concatenate([[0], np.cumsum(self.table[:, 1])])
        source.seek(int(self.at[n - 1]) + 8)
        index = zstandard.decompress(source.read(int(self.table[n - 1, 0]) - 8))
        half = len(index) // 2
        self.ids = np.frombuffer(index[:half], "<i8")
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(index[half:], "<u8").astype(np.int64))])
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.at[k]))
        raw = zstandard.decompress(self.source.read(int(self.table[k, 0])))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        self.frames_read += 1
        return raw

    def document(self, i: int) -> bytes:
        """Ids of the i-th document; reads only the frames that hold it."""
        s, e = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1])
        k = bisect.bisect_right(self.raw, s) - 1
        parts = []
        while s < e:
            part = self.frame(k)[s - int(self.raw[k]) : e - int(self.raw[k])]
            parts.append(part)
            s += len(part)
            k += 1
        return b"".join(parts)

    def find(self, doc_id: int | None) -> range:
        """Positions of the documents of that id."""
        x = NO_ID if doc_id is None else doc_id
        return range(bisect.bisect_left(self.ids, x), bisect.bisect_right(self.ids, x))

    def __iter__(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first id's place in the file, number of ids, crc32 of the ids) of each document, unpacking each frame once."""
        k, raw, base = -1, b"", 0
        for i, x in enumerate(self.ids.tolist()):
            s, e, crc = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1]), 0
            at = s
            while at < e:
                if at >= base + len(raw):
                    k += 1
                    raw, base = self.frame(k), int(self.raw[k])
                part = raw[at - base : e - base]
                crc = zlib.crc32(part, crc)
                at += len(part)
            yield None if x == NO_ID else x, s // 4, (e - s) // 4, crc


@dataclass(frozen=True)
class TokenFile:
    number: int
    path: str
    docs: int
    tokens: int
    first_token: int  # ids in all files before it


def write(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, files: int | None = None, frame_ids: int = 65_536) -> list[TokenFile]:
    """Encode ``docs`` (doc_id, text) and write them under ``path``; ``files`` defaults to the session's shuffle partitions."""
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_h"))
    ordered = hashed.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    end = struct.pack("<I", end_id)

    def task(batches):
        enc = encoder(tokenizer)
        number = TaskContext.get().partitionId()
        fs, base = file_system(path)
        writer = out = None
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for s, e in blocks(pc.utf8_length(texts).to_pylist(), 4_000_000):
                for doc_id, x in zip(ids[s:e], enc.ids(texts.slice(s, e - s).to_pylist())):
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        part = f"{base}/.{number:06d}-{uuid.uuid4().hex}"
                        out = fs.open_output_stream(part)
                        writer = FrameWriter(out, frame_ids)
                    writer.add(doc_id, x + end)
        if writer is not None:
            writer.close()
            out.close()
            name = f"tokens-{number:06d}.zst"
            fs.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"number": [number], "path": [f"{path}/{name}"], "docs": [len(writer.ids)], "tokens": [sum(writer.counts)]})

    rows = in_tasks(ordered, task, "number long, path string, docs long, tokens long").collect()
    out, at = [], 0
    for r in sorted(rows):
        out.append(TokenFile(r["number"], r["path"], r["docs"], r["tokens"], at))
        at += r["tokens"]
    return out


def read(spark: SparkSession, files: list[TokenFile]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back frame by frame."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    listed = spark.createDataFrame([(f.path, f.first_token) for f in files], "path string, first_token long")

    def task(batches):
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first_token").to_pylist()):
                fs, at = file_system(path)
                with fs.open_input_file(at) as source:
                    rows = []
                    for doc_id, start, n, crc in FrameReader(source):
                        rows.append((doc_id, first + start, n, crc))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return listed.repartition(max(1, len(files))).mapInArrow(task, schema)


def fetch(files: list[TokenFile], doc_id: int | None) -> list[np.ndarray]:
    """Ids of the documents of one id, from a few frames; for single lookups (files are probed in order)."""
    out = []
    for f in files:
        fs, at = file_system(f.path)
        with fs.open_input_file(at) as source:
            r = FrameReader(source)
            out += [np.frombuffer(r.document(i), "<u4") for i in r.find(doc_id)]
    return out
