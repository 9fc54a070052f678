"""WARC archives with a two-level capture index.

Archives: gzip members, one a record, after a ``warcinfo`` record; a ``response`` holds the payload behind a short HTTP head, a
``revisit`` (profile identical-payload-digest) only the head and whom it refers to. Record ids are ``<urn:capture:PAGE_ID:DIGEST>``.

Index: one line a capture, sorted by reversed host and rest of the url (``com,example,www)/path``), then page_id. Lines lie in compressed blocks;
behind its blocks each index file has a sparse directory (first key, place and size of each block) and a footer that says where the directory is. A look-up
bisects the first keys of the files, then one directory, reads that block alone by its range, bisects its lines, and reads the
record's range in the archive: no file is read whole.

As Spark jobs: :func:`decide` groups digests (partial aggregation; only digests that occur twice or more are joined back, and Spark broadcasts them
if their written size allows; else AQE splits a hot digest). :func:`write_archives` writes archives where the rows are and returns index lines, :func:`write_index`
range-partitions and sorts these and writes the index files. :func:`look_up` takes any number of distinct captures in key order, so each block is unpacked once a task, and
:func:`read_records` takes found places in archive order and reads neighbours in one range. Files are written to the folder given (shared by
driver and executors), each attempt of a task under a name of its own; only lines of the attempt that counted name a file, so a task that runs again does no harm.
The driver gets one row an index file.

Defined results: a null payload is empty; a null url (or one without ``://``) has no host; null page_ids come first, are smaller than any id
and are looked up like any other; rows with equal payloads that share the largest page_id are all responses (so are all if none has an id); repeated rows have a
record each; -2**63 is taken for no page_id; an empty table gives no archive and no index file. Other columns are ignored. Line breaks and other control characters of a url are percent-encoded in record heads
only. Pages hold no capture time, so ``date`` is a parameter.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meshframes.llm.common import stored
from meshframes.llm.token_frames import file_system

DATE = "2000-01-01T00:00:00Z"
#: A task begins another archive after so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Lines of an index block.
BLOCK_LINES = 2_000
#: Ranges of an archive at most so far apart are read as one, up to so many bytes.
GAP, READ_BYTES = 1 << 16, 4 << 20
FOOT = struct.Struct("<QQ8s")
MAGIC = b"CAPTIDX1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def capture_key(url: Column) -> Column:
    """Reversed host, ``)`` and the rest; A-Z of the host lower-cased."""
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.regexp_replace(whole, r"(?s)^.*?://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha, refers_to, refers_url) of ``pages`` (page_id, url, html): ``refers_to`` is null for responses.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is the response."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.make_valid_utf8("url").alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= least_bytes).select("sha", "page_id", "url")
    best = long.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("best")).where("n > 1")
    best = stored(best.select("sha", F.col("best.page_id").alias("best_id"), F.col("best.url").alias("best_url")), "equal-payloads")
    revisit = (F.col("best_id").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("best_id"))
    joined = rows.join(best, "sha", "left")
    return joined.select(
        "page_id", "url", "payload", "sha", F.when(revisit, F.col("best_id")).alias("refers_to"), F.when(revisit, F.col("best_url")).alias("refers_url")
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:capture:{'' if page_id is None else page_id}:{digest}>"


def id_of(record: str) -> int | None:
    x = record.split(":")[2]
    return int(x) if x else None


def _head_url(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record(head: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(text.encode("utf-8", "replace") + block + b"\r\n\r\n") + pack.flush()


def capture_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_url: str | None, revisit: bool, date: str, level: int) -> bytes:
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _head_url(url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", _head_url(refers_url)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _record(head, http if revisit else http + payload, level)


def parse_record(packed: bytes) -> dict:
    """Fields of one record; the payload of a response is held against its digest."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or len(rest) != len(block) + 4:
        raise ValueError("a record is damaged")
    kind = fields["WARC-Type"]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": id_of(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": id_of(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


LINES = "key string, page_id long, url string, record_type string, digest string, path string, offset long, length long"


def write_archives(decided: DataFrame, path: str, date: str = DATE, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of :func:`decide` as archives under ``path``; returns the index lines, stored. Each partition writes archives of its own."""

    def task(batches):
        fs, base = file_system(path)
        out = name = None
        size = 0
        try:
            for b in batches:
                lines = []
                for key, page_id, url, payload, n, sha, refers, refers_url, revisit in zip(*(b.column(i).to_pylist() for i in range(9))):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
                        out.write(info)
                        size = len(info)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    rec = capture_record(page_id, url, payload, n, digest, refers, refers_url, revisit, date, level)
                    out.write(rec)
                    lines.append((key, page_id, url, "revisit" if revisit else "response", digest, f"{path}/{name}", size, len(rec)))
                    size += len(rec)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()])], names=[f.split()[0] for f in LINES.split(", ")])
        finally:
            if out is not None:
                out.close()

    revisit = F.col("refers_to").isNotNull()
    # a revisit's payload stays behind, its size is told
    payload = [F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), F.octet_length("payload").alias("size")]
    rows = decided.select(capture_key(F.col("url")).alias("key"), "page_id", "url", *payload, "sha", "refers_to", "refers_url", revisit.alias("revisit"))
    return stored(rows.mapInArrow(task, LINES), "capture-lines")


@dataclass(frozen=True)
class IndexFile:
    path: str
    first: tuple[str, int]  # key and page_id of its first line
    lines: int


#: Stands for no page_id in the index; smaller than any id.
NO_ID = -(1 << 63)


class IndexWriter:
    """Blocks of sorted lines, then the directory, then the footer."""

    def __init__(self, out, block_lines: int = BLOCK_LINES) -> None:
        self.out, self.most = out, block_lines
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.directory: list[tuple[str, int, int, int]] = []
        self.held: list[str] = []
        self.first = None
        self.at = self.lines = 0

    def add(self, key: str, page_id: int, place: list) -> None:
        if not self.held:
            self.first = (key, page_id)
        self.held.append(json.dumps([key, page_id, *place], ensure_ascii=False))
        self.lines += 1
        if len(self.held) >= self.most:
            self._flush()

    def _flush(self) -> None:
        packed = self.pack.compress("\n".join(self.held).encode("utf-8", "surrogatepass"))
        self.out.write(packed)
        self.directory.append((*self.first, self.at, len(packed)))
        self.at += len(packed)
        self.held = []

    def close(self) -> None:
        if self.held:
            self._flush()
        packed = self.pack.compress(json.dumps(self.directory).encode())
        self.out.write(packed + FOOT.pack(self.at, len(packed), MAGIC))


class IndexReader:
    """One index file; ``blocks_read`` counts the blocks unpacked."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.size()
        source.seek(end - FOOT.size)
        at, size, magic = FOOT.unpack(source.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("the index has no footer")
        source.seek(at)
        entries = json.loads(zstandard.decompress(source.read(size)))
        self.firsts = [(k, i) for k, i, _, _ in entries]
        self.places = [(a, n) for _, _, a, n in entries]
        self.blocks_read, self.block_no, self.block = 0, -1, []

    def lines(self, k: int) -> list[list]:
        if k != self.block_no:
            self.source.seek(self.places[k][0])
            raw = zstandard.decompress(self.source.read(self.places[k][1]))
            self.block = [json.loads(x) for x in raw.decode("utf-8", "surrogatepass").split("\n")]
            self.block_no = k
            self.blocks_read += 1
        return self.block

    def find(self, low: tuple[str, int], high: tuple[str, int]) -> Iterator[list]:
        """Lines from ``low`` to ``high``, both included."""
        k = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while k < len(self.firsts) and self.firsts[k] <= high:
            block = self.lines(k)
            for i in range(bisect.bisect_left(block, low, key=lambda x: (x[0], x[1])), len(block)):
                if (block[i][0], block[i][1]) > high:
                    return
                yield block[i]
            k += 1


def write_index(lines: DataFrame, path: str, files: int | None = None, block_lines: int = BLOCK_LINES) -> list[IndexFile]:
    """Sort index lines by (key, page_id) over ``files`` range partitions (the session's shuffle partitions by default) and write an index file for each."""
    spark = lines.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "path", "offset"]
    ordered = lines.withColumn("page_id", F.coalesce("page_id", F.lit(NO_ID))).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def task(batches):
        fs, base = file_system(path)
        writer = out = first = None
        for b in batches:
            for key, page_id, url, kind, digest, file, offset, length in zip(*(b.column(i).to_pylist() for i in range(8))):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    writer, first = IndexWriter(out, block_lines), (key, page_id)
                writer.add(key, page_id, [url, kind, digest, file, offset, length])
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "key": [first[0]], "page_id": [first[1]], "lines": [writer.lines]})

    rows = ordered.mapInArrow(task, "path string, key string, page_id long, lines long").collect()
    return sorted((IndexFile(r["path"], (r["key"], r["page_id"]), r["lines"]) for r in rows), key=lambda f: (f.first, f.path))


class Index:
    """All index files; opens one at a time, as searches come in key order or one by one."""

    def __init__(self, files: list[IndexFile]) -> None:
        self.files, self.firsts = files, [f.first for f in files]
        self.number, self.reader, self.source = -1, None, None

    def _open(self, k: int) -> IndexReader:
        if k != self.number:
            if self.source is not None:
                self.source.close()
            fs, at = file_system(self.files[k].path)
            self.source = fs.open_input_file(at)
            self.reader, self.number = IndexReader(self.source), k
        return self.reader

    def find(self, key: str, page_id: int | None = None, every: bool = False) -> Iterator[list]:
        """Lines of a key, of one page_id (None: of captures without one) or, with ``every``, of all."""
        x = NO_ID if page_id is None else page_id
        low, high = ((key, NO_ID), (key, (1 << 63) - 1)) if every else ((key, x), (key, x))
        k = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while k < len(self.files) and self.firsts[k] <= high:
            yield from self._open(k).find(low, high)
            k += 1


FOUND = "page_id long, url string, record_type string, digest string, path string, offset long, length long"
_FOUND = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("url", "record_type", "digest", "path")), ("offset", pa.int64()), ("length", pa.int64())])


def look_up(wanted: DataFrame, files: list[IndexFile], every: bool = False) -> DataFrame:
    """Places of the captures of ``wanted`` (url and, unless ``every`` capture of a url is wanted, page_id): one row a capture found."""
    spark = wanted.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = wanted.select(capture_key(F.col("url")).alias("key"), *([] if every else [F.col("page_id").cast("long").alias("page_id")])).distinct()
    ordered = keys.repartitionByRange(n, *keys.columns).sortWithinPartitions(*keys.columns)

    def task(batches):
        index = Index(files)
        for b in batches:
            ids = [None] * b.num_rows if every else b.column("page_id").to_pylist()
            rows = []
            for key, page_id in zip(b.column("key").to_pylist(), ids):
                for _, i, *place in index.find(key, page_id, every):
                    rows.append((None if i == NO_ID else i, *place))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)

    return ordered.mapInArrow(task, FOUND)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _ranges(places: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Runs of neighbouring (offset, length) places of one archive."""
    path, run = None, []
    for p, offset, length in places:
        if run and (p != path or offset - sum(run[-1]) > GAP or offset + length - run[0][0] > READ_BYTES):
            yield path, run
            run = []
        path = p
        run.append((offset, length))
    if run:
        yield path, run


def read_records(found: DataFrame, payload: bool = False) -> DataFrame:
    """Records at the places found, read range by range in archive order and checked; with ``payload`` the bytes too (null for revisits)."""
    spark = found.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["path", "offset", "length"]
    ordered = found.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    fields = [*_RECORD, ("payload", pa.binary())] if payload else _RECORD
    schema = pa.schema(fields)

    def task(batches):
        places = (x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(3))))
        at, source = None, None
        for path, run in _ranges(places):
            if path != at:
                fs, file = file_system(path)
                source, at = fs.open_input_file(file), path
            source.seek(run[0][0])
            raw = source.read(sum(run[-1]) - run[0][0])
            rows = [parse_record(raw[o - run[0][0] : o - run[0][0] + n]) for o, n in run]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in fields], schema=schema)

    return ordered.mapInArrow(task, RECORD + (", payload binary" if payload else ""))


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> list[IndexFile]:
    """Write ``pages`` (page_id, url, html) as archives and index under ``path``."""
    return write_index(write_archives(decide(pages, least_bytes), f"{path}/archive"), f"{path}/index")


def read_back(spark: SparkSession, wanted: DataFrame, files: list[IndexFile], payload: bool = False) -> DataFrame:
    return read_records(look_up(wanted, files), payload)


SQL = """
with p as (
  select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages
), g as (
  select *, max(page_id) over (partition by x) as best from p
), b as (
  select *, best is not null and page_id is distinct from best as again from g
)
select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((cast('0x' || x[i * 5 + 1:i * 5 + 5] as bigint) >> 15) & 31) + 1] ||
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((cast('0x' || x[i * 5 + 1:i * 5 + 5] as bigint) >> 10) & 31) + 1] ||
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((cast('0x' || x[i * 5 + 1:i * 5 + 5] as bigint) >> 5) & 31) + 1] ||
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(cast('0x' || x[i * 5 + 1:i * 5 + 5] as bigint) & 31) + 1]), '') as payload_digest,
  case when again then 'revisit' else 'response' end as record_type,
  case when again then best end as refers_to
from b
"""
