"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds 64-bit hashes of its distinct shingles of ``WORDS`` words (A-Z lower-cased; words as in the quality rules). Two
documents link when ``100 * intersection >= 80 * union``. Documents with one set are one class, so copies cost one row.

Shingles are ordered alike everywhere: first those not known to be frequent, by hash, then frequent ones by estimated
document frequency (a bounded table, see :func:`frequent`). A document of n shingles shares at least ``o = ceil(0.8 n)`` with any partner, so
among the first ``n - o + l`` shingles of both (their l-prefixes) two linked documents share at least l. Each document chooses its l by estimated
cost (:func:`prefixes`): longer prefixes mean more postings, but a partner must share more of them before anything is verified, and
documents that merely share a passage don't. No document's l is below a floor that depends on its size alone, which gives a bound that
holds whatever partners chose.

1. Prefix shingles are dealt to buckets, as packed arrays; shingles found in one class only vanish there.
2. Classes that share fewer prefix shingles than the floor for their smallest possible partner drop out.
3. Of shingles held by up to ``TOGETHER`` classes the pairs are counted (a row a pair and shingle, so at most ``TOGETHER / 2`` rows a posting): pairs whose sizes
   fit and that share the smaller of their l are candidates. Classes that share a shingle held by more hang together by a star instead, as
   a group of thousands of near copies would make all its pairs; a pair of which only one class holds such shingles is told by the others alone.
   What hangs together by candidates and stars is a cluster (components). Whole sets are fetched for
   clusters only. A cluster is cut into blocks by set size, and each pair of blocks that can hold partners is one unit of work (most clusters are one).
4. Within a pair of blocks, classes that stand together by a min-hash are verified first, which joins most of a group of near copies in one pass. Then prefix matches
   of classes not yet joined are counted, some rows against all at a time, and pairs with l or more are verified on the whole sets, unless links found there
   already join them. Links join the classes (components again); each row gets the smallest doc_id.

No step lists the pairs of a large group as rows, and no group is gathered whole. Defined results: null, empty and blank texts have no shingles and
link with nothing (component: the own doc_id); with fewer words than ``WORDS`` the whole sequence is the only shingle; repeated rows and
equal texts are one class; a null doc_id takes part in links, but is never a component's name (null if it is alone); an empty
table gives no rows; ``n_shingles`` and ``component_id`` are the only added columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from meshframes.llm.common import blocks, groups, in_tasks, stored, with_arrow_columns
from meshframes.llm.components import components
from meshframes.llm.lang_id import mix

WORDS = 5
#: Links need NUM * union <= DEN * intersection.
NUM, DEN = 80, 100
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
CHUNK = 250_000
#: How many postings the verification of a candidate is worth in the cost estimate.
VERIFY = 16.0
#: A cluster is compared in blocks of about so many classes, fewer if their sets are large: so many shingles in all.
BLOCK_CLASSES, BLOCK_SHINGLES = 6_000, 1_200_000
#: Of a pair of blocks, counts of so many pairs are held at once; frequent shingles are counted so many at a time.
TILE, DENSE = 500_000, 512
#: Shingles held by more classes are joined by stars, not by pairs.
TOGETHER = 64
#: Postings to a bucket, about, and buckets to a partition: a task sorts one bucket at a time.
BUCKET_POSTINGS, BUCKETS = 250_000, 4
#: At most so many shingles are known to be frequent.
FREQUENT = 2_000_000
#: Bits of the filter that tells which texts are worth a join.
ID_FILTER_BITS = 1 << 24
BASE = np.uint64(0x9E3779B97F4A7C15)
STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_POWERS = [np.cumprod(np.full(64, BASE, np.uint64))]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word."""
    a = np.frombuffer(text, np.uint8)
    solid = ~SPACE[a]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    begins = np.ones(len(at), bool)
    begins[1:] = np.diff(at) > 1
    first = np.flatnonzero(begins)
    place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    longest = int(place.max()) + 1
    if longest > len(_POWERS[0]):
        _POWERS[0] = np.cumprod(np.full(2 * longest, BASE, np.uint64))
    h = np.add.reduceat((a[at].astype(np.uint64) + np.uint64(1)) * _POWERS[0][place], first)
    return mix(h), at[first]


def _cuts(text: bytes) -> Iterator[bytes]:
    """Parts of about CHUNK bytes, cut at white space."""
    s = 0
    while s < len(text):
        e = s + CHUNK
        while e < len(text) and not SPACE[text[e]]:
            e += 1
        yield text[s:e]
        s = e


def _shingles(w: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each of n documents, from the word hashes in order."""
    count = np.bincount(doc, minlength=n)
    ends = np.cumsum(count)
    if len(w) >= WORDS:
        s = w[: len(w) - WORDS + 1] * STEPS[0]
        for j in range(1, WORDS):
            s = s + w[j : len(w) - WORDS + 1 + j] * STEPS[j]
        s = mix(s)
    out = []
    for c, e in zip(count.tolist(), ends.tolist()):
        if c >= WORDS:
            out.append(np.unique(s[e - c : e - WORDS + 1]))
        elif c:
            out.append(mix(np.sum(w[e - c : e] * STEPS[:c], keepdims=True) + np.uint64(c)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for s, e in blocks([len(t) for t in texts], CHUNK):
        part = [t.translate(LOWER) for t in texts[s:e]]
        if e - s == 1 and len(part[0]) > CHUNK:
            w = np.concatenate([word_hashes(x)[0] for x in _cuts(part[0])])
            out += _shingles(w, np.zeros(len(w), np.int64), 1)
            continue
        w, at = word_hashes(b"\n".join(part))
        starts = np.cumsum([0, *(len(t) + 1 for t in part)])
        out += _shingles(w, np.searchsorted(starts, at, side="right") - 1, e - s)
    return out


def class_of(s: np.ndarray) -> int:
    """A hash of the whole set."""
    x = np.sum(mix(s ^ STEPS[4]), dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * STEPS[3]
    return int(mix(x).view(np.int64)[0])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        raw = pc.fill_null(b.column("text"), "").cast(pa.large_binary())
        for s, e in blocks(pc.binary_length(raw).to_pylist(), 4 * CHUNK):
            yield b.slice(s, e - s), shingle_sets(raw.slice(s, e - s).to_pylist())


def _distinct(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[dict[int, np.ndarray]]:
    """Blocks of about so many shingles in all, each class once a block."""
    held: dict[int, np.ndarray] = {}
    size = 0
    for _, sets in _sets(batches):
        for s in sets:
            if len(s) and (c := class_of(s)) not in held:
                held[c] = s
                size += len(s)
        if size >= tokens:
            yield held
            held, size = {}, 0
    if held:
        yield held


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, cls) of each row; cls is null without shingles."""

    def task(batches):
        for b, sets in _sets(batches):
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n_shingles", "cls"])

    return in_tasks(docs.select(F.col("doc_id").cast("long"), "text"), task, "doc_id long, n_shingles long, cls long")


@dataclass(frozen=True)
class Frequent:
    """Shingles known to be frequent, in order, with estimates of their document frequency."""

    shingles: np.ndarray
    counts: np.ndarray


def frequent(docs: DataFrame, total: int, least: int = 64) -> Frequent:
    """Shingles found in ``least`` classes or more, as far as they repeat within blocks of the input (an estimate from below, which
    only the order of shingles depends on). Counts add up to ``total`` at most, so at most FREQUENT shingles reach the driver."""

    def task(batches):
        for held in _distinct(batches, 2_000_000):
            u, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], names=["s", "n"])

    least = max(least, -(-total // FREQUENT))
    found = in_tasks(docs.select("text"), task, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    s, n = found.column("s").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(s)
    return Frequent(s[order], n[order])


def overlap(n: int) -> int:
    """Shingles that a document of n has in common with any partner, at least."""
    return -(-NUM * n // DEN)


def floor_matches(n: int) -> int:
    """The least l of a document of n shingles; grows with n."""
    return max(1, min(overlap(n), int(np.sqrt((n - overlap(n)) * VERIFY))))


def least_matches(n: int) -> int:
    """Matches that a document of n shares with any partner, whatever l the partner chose."""
    return floor_matches(overlap(n))


def prefixes(s: np.ndarray, known: Frequent) -> tuple[np.ndarray, int]:
    """(the prefix in the global order, l) of a set."""
    n = len(s)
    o, l = overlap(n), floor_matches(n)
    if len(known.shingles):
        at = np.minimum(np.searchsorted(known.shingles, s), len(known.shingles) - 1)
        cost = np.where(known.shingles[at] == s, known.counts[at], 0)
        if cost.any():
            order = np.lexsort((s, cost))
            s, total = s[order], np.cumsum(np.maximum(1, cost[order]))
            choices = [x for x in (l, 2 * l, 4 * l) if x <= o] or [l]
            l = min(choices, key=lambda x: total[n - o + x - 1] * (1 + VERIFY / x))
    return s[: n - o + l], l


def shared_prefixes(docs: DataFrame, known: Frequent, total: int) -> DataFrame:
    """(shingle, cls, need, n, l) of prefix shingles found in two classes or more; need: :func:`least_matches` of the class, n: its shingles."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (3 * BUCKETS * BUCKET_POSTINGS)))
    buckets = parts * BUCKETS
    shared = spark.sparkContext.broadcast(known)  # bounded by FREQUENT

    def deal(batches):
        for held in _distinct(batches, 2_000_000):
            cls = np.fromiter(held, np.int64, len(held))
            need = np.fromiter((least_matches(len(s)) for s in held.values()), np.int32, len(held))
            chosen = [prefixes(s, shared.value) for s in held.values()]
            pre = [p for p, _ in chosen]
            wide = np.fromiter(map(len, held.values()), np.int32, len(held))
            least = np.fromiter((x for _, x in chosen), np.int32, len(held))
            flat = np.concatenate(pre)
            owner = np.repeat(np.arange(len(pre), dtype=np.int32), [len(p) for p in pre])
            bucket = (mix(flat) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            flat, owner, bucket = flat[order], owner[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = []
            for s, e in zip(cuts, np.append(cuts[1:], len(bucket))):
                some, size = np.unique(owner[s:e], return_counts=True)
                rows.append((int(bucket[s]), cls[some].tobytes(), need[some].tobytes(), wide[some].tobytes(), least[some].tobytes(), size.astype("<i4").tobytes(), flat[s:e].tobytes()))
            names = ["bucket", "cls", "need", "n", "l", "size", "shingles"]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)

    def meet(batches):
        for _, parts in groups(batches, ["bucket"]):
            read = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for b in parts for x in b.column(name)])
            size = read("size", "<i4")
            of = np.repeat(np.arange(len(size)), size)
            known, s = {c: read(c, np.int32) for c in ("need", "n", "l")}, read("shingles", np.uint64)
            cls = read("cls", np.int64)
            order = np.lexsort((cls[of], s))
            s, of = s[order], of[order]
            once = np.ones(len(s), bool)
            once[1:] = (s[1:] != s[:-1]) | (cls[of[1:]] != cls[of[:-1]])
            s, of = s[once], of[once]
            same = s[1:] == s[:-1]
            keep = np.zeros(len(s), bool)
            keep[1:] |= same
            keep[:-1] |= same
            s, of = s[keep], of[keep]
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(cls[of]), *(pa.array(x[of]) for x in known.values())], names=["shingle", "cls", *known])

    dealt = in_tasks(docs.select("text"), deal, "bucket long, cls binary, need binary, n binary, l binary, size binary, shingles binary")
    together = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return in_tasks(together, meet, "shingle long, cls long, need int, n int, l int")


def peel(shared: DataFrame) -> DataFrame:
    """Drops classes with fewer matches than they need (a class has its prefix at most, so a window holds it)."""
    found = shared.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("cls")))
    return stored(found.where("found >= need").select("shingle", "cls", "n", "l"), "shared-prefixes")


def candidates(left: DataFrame) -> DataFrame:
    """(a, b): what may be linked, by pairs and by stars of shingles that many classes hold."""
    many = stored(left.groupBy("shingle").count().where(F.col("count") > TOGETHER).select("shingle"), "common-shingles")
    few = left.join(many, "shingle", "left_anti").groupBy("shingle").agg(F.array_sort(F.collect_list(F.struct("cls", "n", "l"))).alias("s"))  # TOGETHER at most

    def pair(x, y):
        fits = (DEN * F.least(x["n"], y["n"]) >= NUM * F.greatest(x["n"], y["n"])).alias("fits")
        return F.struct(x["cls"].alias("a"), y["cls"].alias("b"), F.least(x["l"], y["l"]).alias("need"), fits)

    behind = F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: pair(x, y)))
    pairs = few.select(F.explode(F.filter(F.flatten(behind), lambda p: p["fits"])).alias("p")).select("p.a", "p.b", "p.need")
    found = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.max("need").alias("need")).where("m >= need").select("a", "b")
    stars = left.join(many, "shingle").select("shingle", "cls")
    hubs = stars.groupBy("shingle").agg(F.min("cls").alias("b"))
    return found.union(stars.join(hubs, "shingle").select(F.col("cls").alias("a"), "b"))


def _blocks(members: DataFrame) -> DataFrame:
    """(cluster, cls, unit, side): the pairs of blocks in which each class of ``members`` (cluster, cls, n) is compared.

    Blocks follow set sizes; only blocks whose sizes can hold partners are paired."""
    share = F.col("count") * F.greatest(F.lit(1 / BLOCK_CLASSES), F.col("n") / BLOCK_SHINGLES)  # of a block
    by = members.groupBy("cluster", "n").count().withColumn("share", share)
    up = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("at", F.floor(F.coalesce(F.sum("share").over(up), F.lit(0)))).withColumn("slices", F.ceil("share").cast("int"))
    placed = members.join(by.drop("count", "share"), ["cluster", "n"]).withColumn("slice", F.when(F.col("slices") > 1, F.pmod(F.xxhash64("cls"), "slices")).otherwise(F.lit(-1)))
    placed = placed.withColumn("n0", F.when(F.col("slices") > 1, F.col("n")).otherwise(F.lit(0)))
    placed = stored(placed.select("cluster", "cls", "n", F.struct("at", "n0", "slice").alias("block")), "join-blocks")
    each = placed.groupBy("cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = each.alias("a"), each.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.block") <= F.col("b.block")) & (DEN * F.col("a.most") >= NUM * F.col("b.least")) & (DEN * F.col("b.most") >= NUM * F.col("a.least")))
    pairs = pairs.select(F.col("a.cluster").alias("cluster"), F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    sides = pairs.select("cluster", F.col("x").alias("block"), F.struct("x", "y").alias("unit"), F.lit(0).alias("side")).union(
        pairs.where("x <> y").select("cluster", F.col("y").alias("block"), F.struct("x", "y").alias("unit"), F.lit(1).alias("side")))
    return placed.join(sides, ["cluster", "block"]).select("cluster", "cls", "unit", "side")


def _verified(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


class Parts:
    """Joined parts of a unit's classes; ``label`` tells whose part each is in, for whole arrays at once."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[i]] = self.label[j]


def _join_neighbours(sets: list[np.ndarray], parts: Parts) -> list[tuple[int, int]]:
    """Links between classes that stand together by a min-hash: one pass over the classes for each of three, so a group of near
    copies is joined without a look at its pairs."""
    out = []
    n = np.array([len(s) for s in sets])
    for key in (lambda s: s[0], lambda s: s[-1], lambda s: mix(s).min()):
        keys = np.array([key(s) for s in sets], np.uint64)
        order = np.lexsort((n, keys))
        for a, b in zip(order[:-1][same := keys[order[1:]] == keys[order[:-1]]].tolist(), order[1:][same].tolist()):
            if parts.label[a] != parts.label[b] and _verified(sets[a], sets[b]):
                parts.join(a, b)
                out.append((a, b))
    return out


class Matches:
    """Prefix shingles that classes of different parts have in common, counted for some rows against all classes."""

    def __init__(self, pre: list[np.ndarray], label: np.ndarray) -> None:
        self.n = len(pre)
        owner = np.repeat(np.arange(self.n), [len(p) for p in pre])
        _, col, count = np.unique(np.concatenate(pre), return_inverse=True, return_counts=True)
        order = np.argsort(col, kind="stable")
        owner, col = owner[order], col[order]
        starts = np.cumsum(count) - count
        # a shingle of one part only can link nothing new
        useful = np.minimum.reduceat(label[owner], starts) != np.maximum.reduceat(label[owner], starts)
        wide = useful & (count > max(32, self.n // 16))
        few = useful & ~wide
        self.wide_owner, self.wide_col = owner[wide[col]], (np.cumsum(wide) - 1)[col[wide[col]]]
        # members of a shingle stand together, in ascending order: each is paired with those behind it
        at = np.arange(len(col))
        behind = (starts + count)[col] - at - 1
        some = np.flatnonzero(few[col] & (behind > 0))
        some = some[np.argsort(owner[some], kind="stable")]
        self.owner, self.first, self.partner, self.behind = owner[some], at[some] + 1, owner, behind[some]

    def rows(self, start: int, end: int) -> np.ndarray:
        """Counts of the pairs (i, j) of rows i from ``start`` to ``end``; those with j <= i may be less."""
        total = np.zeros((end - start, self.n), np.float32)
        last = int(self.wide_col[-1]) + 1 if len(self.wide_col) else 0
        for c in range(0, last, DENSE):
            s, e = np.searchsorted(self.wide_col, [c, c + DENSE])
            x = np.zeros((self.n, DENSE), np.float32)
            x[self.wide_owner[s:e], self.wide_col[s:e] - c] = 1.0
            if x[start:end].any():
                total += x[start:end] @ x.T
        flat = total.reshape(-1)
        s, e = np.searchsorted(self.owner, [start, end])
        for p, q in blocks(self.behind[s:e].tolist(), TILE):
            n, row = self.behind[s + p : s + q], self.owner[s + p : s + q] - start
            place = np.repeat(self.first[s + p : s + q] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            np.add.at(flat, np.repeat(row, n) * self.n + self.partner[place], 1)
        return total


def links(cls: np.ndarray, sets: list[np.ndarray], side: np.ndarray, known: Frequent) -> list[tuple[int, int]]:
    """Verified links that join what is linked in a pair of blocks (links inside a joined part are left out)."""
    parts = Parts(len(sets))
    out = _join_neighbours(sets, parts)
    if (parts.label == parts.label[0]).all():
        return [(int(cls[a]), int(cls[b])) for a, b in out]
    chosen = [prefixes(s, known) for s in sets]
    l, n, left = np.array([x for _, x in chosen]), np.array([len(s) for s in sets]), side == 0
    one_block = bool(left.all())
    shared = Matches([p for p, _ in chosen], parts.label)
    step = max(1, TILE // len(sets))
    for start in range(0, len(sets), step):
        total = shared.rows(start, min(start + step, len(sets)))
        i, j = np.nonzero((total > 0) & (parts.label[start : start + step, None] != parts.label[None, :]))
        m, i = total[i, j], i + start
        ok = (i < j) & (m >= np.minimum(l[i], l[j])) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))
        if not one_block:
            ok &= left[i] != left[j]  # pairs within a block have a unit of their own
        i, j, m = i[ok], j[ok], m[ok]
        order = np.argsort(-m / np.minimum(n[i], n[j]), kind="stable")
        i, j = i[order], j[order]
        for s in range(0, len(i), 256):
            a, b = i[s : s + 256], j[s : s + 256]
            apart = parts.label[a] != parts.label[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                if parts.label[x] != parts.label[y] and _verified(sets[x], sets[y]):
                    parts.join(x, y)
                    out.append((x, y))
    return [(int(cls[a]), int(cls[b])) for a, b in out]


def join_classes(docs: DataFrame, named: DataFrame, known: Frequent, total: int) -> DataFrame:
    """(a, b): links between classes; ``named``: (doc_id, n_shingles, cls) of each row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = peel(shared_prefixes(docs, known, total))
    found = components(candidates(left), "join-clusters")
    clusters = found.union(found.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("cls"), F.col("b").alias("cluster"))
    first = named.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    members = stored(first.join(clusters, "cls"), "join-members")
    units = _blocks(members.select("cluster", "cls", "n"))
    shared = spark.sparkContext.broadcast(known)  # bounded by FREQUENT

    # texts of classes in clusters, by the smallest doc_id of each; a filter of fixed size lets few others through (more when it
    # is overfull), and the join by class drops those; rows without a doc_id all pass
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ID_FILTER_BITS))
    word = members.where("doc_id is not null").select(F.floor(place / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("v"))
    got = word.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # ID_FILTER_BITS / 64 rows at most
    words = np.zeros(ID_FILTER_BITS // 64, np.uint64)
    words[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    wanted = spark.sparkContext.broadcast(words)

    def fetch(batches):
        def likely():
            for b in batches:
                at = pc.fill_null(b.column("place"), -1).to_numpy()
                hit = (wanted.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
                yield b.filter(pa.array((at < 0) | (hit == 1)))

        for _, sets in _sets(likely()):
            rows = [(class_of(s), s.tobytes()) for s in sets if len(s)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["cls", "shingles"])

    def compare(batches):
        out: list[tuple[int, int]] = []
        for _, rows in groups(batches, ["cluster", "unit"]):
            cls, once = np.unique(np.concatenate([b.column("cls").to_numpy() for b in rows]), return_index=True)  # repeated rows of a class
            if len(cls) > 1:
                sets = [np.frombuffer(x.as_py(), np.uint64) for b in rows for x in b.column("shingles")]
                side = np.concatenate([b.column("side").to_numpy() for b in rows])
                out += links(cls, [sets[i] for i in once], side[once], shared.value)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    texts = docs.select("text", F.when(F.col("doc_id").isNotNull(), place).alias("place"))
    sets = in_tasks(texts, fetch, "cls long, shingles binary")
    work = units.join(sets, "cls").withColumn("unit", F.xxhash64("unit")).repartition(parts, "cluster", "unit").sortWithinPartitions("cluster", "unit", "side", "cls")
    return in_tasks(work.select("cluster", "unit", "side", "cls", "shingles"), compare, "a long, b long")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, cls) of each row, and (cls, root, first, component_id) of each class: the name of
    its component, its own smallest doc_id and its component's."""
    docs = docs.select("doc_id", "text")
    named = stored(identify(docs), "join-classes")
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    known = frequent(docs, total) if total else Frequent(np.empty(0, np.uint64), np.empty(0, np.int64))
    found = components(join_classes(docs, named, known, total), "join-links")
    names = named.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"))
    joined = names.join(found, F.col("cls") == F.col("a"), "left").select("cls", "first", F.coalesce("b", "cls").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return named, joined.join(least, "root").select("cls", "root", "first", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    named, classes = _grouped(docs)
    alone = named.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.where("cls is not null").join(classes, "cls").select("doc_id", "n_shingles", "component_id").union(alone)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) that stay: one of each component, of its smallest doc_id, and all without shingles."""

    def make():
        def run(col: pa.Array):
            raw = pc.fill_null(col, "").cast(pa.large_binary())
            out: list[int | None] = []
            for s, e in blocks(pc.binary_length(raw).to_pylist(), 4 * CHUNK):
                out += [class_of(x) if len(x) else None for x in shingle_sets(raw.slice(s, e - s).to_pylist())]
            return [pa.array(out, pa.int64())]

        return run

    _, classes = _grouped(docs)
    # of a component without doc_ids the class that names it stays
    stays = classes.where(F.col("first").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("cls").alias("__llm_k"), F.first("component_id").alias("__llm_id")).drop("root")
    rows = with_arrow_columns(docs, ["text"], [T.StructField("__llm_cls", T.LongType())], make)
    kept = rows.where("__llm_cls is not null").join(stays, (F.col("__llm_cls") == F.col("__llm_k")) & F.col("doc_id").eqNullSafe(F.col("__llm_id")))
    one = kept.withColumn("__llm_r", F.row_number().over(Window.partitionBy("__llm_cls").orderBy(F.xxhash64("text")))).where("__llm_r = 1")
    return one.select(docs.columns).union(rows.where("__llm_cls is null").select(docs.columns))
