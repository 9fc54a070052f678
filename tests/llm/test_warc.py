import base64
import glob
import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from meshframes.llm import warc
from meshframes.session import scratch_path

PAGES = "page_id long, url string, html string"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, least=0):
    """The contract on Python lists."""
    best = {}
    for i, _, h in rows:
        k = h or ""
        if i is not None and (k not in best or i > best[k]):
            best[k] = i
    out = []
    for i, _, h in rows:
        k = h or ""
        b = best.get(k) if len(k.encode()) >= least else None
        revisit = b is not None and i != b
        out.append((i, len(k.encode()), b32(k), "revisit" if revisit else "response", b if revisit else None))
    return sorted(out, key=str)


AWKWARD = [
    (1, "http://A.Example.com/x?y#z", "<p>eins"), (2, "https://a.example.com/x", "<p>eins"), (3, None, None), (4, "", ""), (5, "no scheme", "é\U0001f600"),
    (6, "http://b.example.com", "long " * 100_000), (6, "http://b.example.com", "long " * 100_000), (7, "http://h/\r\nX: y", "z\r\n\r\nz"), (None, None, None), (None, "http://c/", "lone"),
    (None, "http://c/", "lone"), (8, "http://c/", "WARC/1.1\r\n"), (9, "://", "<p>eins"), (10, "http://user@ÄÖ.de:80/ü?q=://x", "x"), (-3, "http://c/", "x"),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, PAGES)
    for c in ("sha", "n", "best_id", "key", "payload", "offset", "refers_to"):
        df = df.withColumn(c, F.lit("own"))
    return df


def run(spark, df, least=0, **more):
    return warc.read_back(spark, df.select("url", "page_id"), warc.archive(df, scratch_path(spark, "captures"), least), **more)


@pytest.mark.parametrize("least", [0, 6])
def test_read_back(spark, least):
    got = run(spark, frame(spark, AWKWARD), least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(AWKWARD, least)


def test_payloads_come_back(spark):
    got = run(spark, frame(spark, AWKWARD), payload=True)
    by = {r.payload_digest: bytes(r.payload) for r in got.collect() if r.record_type == "response"}
    assert by == {b32(h): (h or "").encode() for _, _, h in AWKWARD}
    assert all(r.payload is None for r in got.collect() if r.record_type == "revisit")


def test_copies_and_a_hot_url(spark):
    rows = [(i, "http://hot.example.com/" if i % 3 else f"http://h{i % 50}.example.com/{i}", "same" if i % 2 else f"page {i % 700}") for i in range(3000)]
    df = frame(spark, rows).repartition(7)
    assert sorted(map(tuple, run(spark, df).collect()), key=str) == plain(rows)


def test_empty_table(spark):
    df = frame(spark, AWKWARD).where("false")
    assert warc.archive(df, scratch_path(spark, "captures")) == [] and run(spark, df).count() == 0


def test_archives_are_plain_gzip_warc(spark):
    path = scratch_path(spark, "captures")
    lines = warc.write_archives(warc.decide(frame(spark, AWKWARD)).coalesce(1), f"{path}/archive", archive_bytes=1000)
    found = glob.glob(f"{path.removeprefix('file:')}/archive/*.warc.gz")
    assert len(found) > 2
    whole = {f: open(f, "rb").read() for f in found}
    for f, raw in whole.items():
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    n = 0
    for r in lines.collect():
        member = whole[r.path.removeprefix("file:")][r.offset : r.offset + r.length]
        assert gzip.decompress(member).startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        n += 1
    assert n == len(AWKWARD)
    with pytest.raises((ValueError, zlib.error)):
        warc.parse_record(member[:40] + b"\0\0" + member[42:])
    text = gzip.decompress(member)
    changed = text[:-5] + bytes([text[-5] ^ 1]) + text[-4:]
    if r.record_type == "response":
        with pytest.raises(ValueError):
            warc.parse_record(gzip.compress(changed))


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_search_reads_one_block():
    out = io.BytesIO()
    w = warc.IndexWriter(out, block_lines=10)
    lines = sorted((f"com,h{i % 37:02d})/{i % 11}", i) for i in range(1000))
    lines += [("z)", 1)] * 35
    for key, i in lines:
        w.add(key, i, [None, "response", "d", "p", i, 1])
    w.close()
    for key, i in set(lines) - {("z)", 1)}:
        r = warc.IndexReader(Source(out.getvalue()))
        assert [x[:2] for x in r.find((key, i), (key, i))] == [[key, i]] and r.blocks_read <= 2
    r = warc.IndexReader(Source(out.getvalue()))
    assert len(list(r.find(("z)", 1), ("z)", 1)))) == 35 and r.blocks_read <= 5
    assert not list(r.find(("com,h05)/99", 5), ("com,h05)/99", 5)))
    assert not list(r.find(("a", 0), ("a", 9))) and not list(r.find(("zz", 0), ("zz", 9)))


def test_index_over_several_files(spark):
    rows = [(i, f"http://h{i % 5}.example.com/p{i % 3}", f"t{i}") for i in range(500)]
    path = scratch_path(spark, "captures")
    lines = warc.write_archives(warc.decide(frame(spark, rows)), f"{path}/archive")
    files = warc.write_index(lines, f"{path}/index", files=6, block_lines=7)
    assert len(files) > 3 and sum(f.lines for f in files) == 500
    index = warc.Index(files)
    assert sorted(x[1] for x in index.find("com,example,h2)/p1", every=True)) == [i for i in range(500) if i % 5 == 2 and i % 3 == 1]
    assert [x[1] for x in index.find("com,example,h2)/p1", 7)] == [7] and not list(index.find("com,example,h2)/p1", 8))
    asked = spark.createDataFrame([("http://H2.example.com/p1",), ("http://none/",), ("http://H2.example.com/p1",)], "url string")
    every = warc.look_up(asked, files, every=True)
    assert sorted(r.page_id for r in every.collect()) == [i for i in range(500) if i % 5 == 2 and i % 3 == 1]


def test_neighbours_are_read_as_one():
    places = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP + 1, 5), ("b", 0, warc.READ_BYTES + 1), ("b", warc.READ_BYTES + 1, 3)]
    assert [r for _, r in warc._ranges(iter(places))] == [[(0, 10), (10, 10)], [(20 + warc.GAP + 1, 5)], [(0, warc.READ_BYTES + 1)], [(warc.READ_BYTES + 1, 3)]]
