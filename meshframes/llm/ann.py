"""Approximate nearest neighbours by cosine with balanced posting lists.

:func:`fit` learns from a bounded, hash-chosen sample (``sample`` vectors): balanced two-means splits halve it until a list would
hold about ``list_size`` of all vectors (``max_lists`` at most; beyond that lists grow and are cut as below), each
part's mean is a centroid, and a neighbourhood graph over the centroids is kept in memory. Every vector is then indexed
(:func:`assign`): in the list of its nearest centroid and, when it lies near a border, in those of other centroids at most ``border`` times as far,
unless a chosen centroid is nearer to that centroid than the vector is (up to ``replicas`` lists).

A query walks the centroid graph best-first and takes every list whose centroid is at most ``ratio`` times as far as the nearest one, and
more if those hold fewer than the vectors asked for. ``ratio`` is calibrated on the sample against brute force for ``recall``; in all
data neighbours are nearer than in a sample, so recall there is no lower.

Neighbouring lists make up a bin, and a bin is dealt out in blocks of ``BLOCK_ROWS`` vectors and ``BLOCK_QUERIES`` queries (fewer where
vectors are long), whatever its size. A vector and a query are sent to a bin once, with the lists of it that they are in or ask for; only
pairs that share a list count. Single precision, less its largest rounding error, tells which of them may be among the k nearest; those are
compared in double precision. No task holds more than a block, so memory grows with neither vectors nor queries nor lists asked. Exact copies of a vector
share one entry with their k + 1 smallest ids, as no other copy can be among the k nearest of any query. Scores are
cosines in double precision of the original vectors; vectors of floats are kept as floats until then.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids or vectors of another length than the
most frequent one (the shortest of several); repeated rows count once; ties go to the smaller id; queries without candidates
give no rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from meshframes.llm.common import in_tasks, release, stored, with_arrow_columns

BLOCK_ROWS = 40_000
BLOCK_QUERIES = 16_000
#: Numbers in a block's vectors, and in an array that is made of them.
BLOCK_VALUES = 2_560_000
ARRAY_VALUES = 1_048_576
#: Bins at least, if there are as many lists, so that small tables are spread over tasks too.
BINS = 64
DEGREE = 24
WALK = 48
BINNED = "array<struct<bin: int, lists: array<int>>>"


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def balanced_lists(x: np.ndarray, lists: int, seed: int = 11) -> np.ndarray:
    """Means (as unit vectors) of ``lists`` parts of equal size, from repeated balanced two-means splits."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < lists and max(map(len, parts)) > 1:
        halves = []
        for p in parts:
            if len(p) < 2:
                halves.append(p)
                continue
            a, b = x[rng.choice(p, 2, replace=False)]
            for _ in range(6):
                order = np.argsort(x[p] @ (a - b), kind="stable")
                left, right = p[order[: len(p) // 2]], p[order[len(p) // 2 :]]
                b, a = x[left].mean(axis=0), x[right].mean(axis=0)
            halves += [left, right]
        parts = halves
    means = np.array([x[p].mean(axis=0) for p in parts])
    means[(means * means).sum(axis=1) < 1e-24] = x[[p[0] for p in parts]][(means * means).sum(axis=1) < 1e-24]
    return unit(means)


def slices(n: int, width: int, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of 0 to ``n`` whose rows of ``width`` numbers make up an array of about ``ARRAY_VALUES``."""
    step = max(1, min(most or n, ARRAY_VALUES // max(1, width)))
    return ((s, min(n, s + step)) for s in range(0, n, step))


def neighbour_graph(c: np.ndarray) -> list[np.ndarray]:
    """The nearest centroids of each, in both directions, and links that make the graph whole."""
    n = len(c)
    links: list[set[int]] = [set() for _ in range(n)]
    for s, e in slices(n, n):
        d = distances(c[s:e], c)
        for i in range(s, e):
            if i:  # every centroid reaches an earlier one, its nearest
                j = int(np.argmin(d[i - s, :i]))
                links[i].add(j)
                links[j].add(i)
        d[np.arange(e - s), np.arange(s, e)] = np.inf
        for i, near in zip(range(s, e), np.argsort(d, axis=1, kind="stable")[:, : min(DEGREE, n - 1)].tolist()):
            links[i].update(near)
            for j in near:
                links[j].add(i)
    return [np.array(sorted(x), np.int64) for x in links]


@dataclass
class Index:
    k: int
    centroids: np.ndarray
    graph: list[np.ndarray]
    border: float
    replicas: int
    ratio: float = 1.2
    held: np.ndarray = field(default_factory=lambda: np.zeros(0))  # ids by list, each in its nearest list only
    sample_recall: float = 0.0

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, is it the nearest list) of each entry, for unit vectors."""
        n = len(self.centroids)
        width = min(n, 4 * self.replicas)
        parts = []
        for s, e in slices(len(x), max(n, width * x.shape[1])):
            d = distances(x[s:e], self.centroids)
            near = np.argpartition(d, width - 1, axis=1)[:, :width] if width < n else np.broadcast_to(np.arange(n), d.shape)
            far = np.take_along_axis(d, near, axis=1)
            order = np.lexsort((near, far), axis=1)
            near, far = np.take_along_axis(near, order, axis=1), np.take_along_axis(far, order, axis=1)
            c = self.centroids[near]
            between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (c @ c.transpose(0, 2, 1))))
            chosen = np.zeros(near.shape, bool)
            chosen[:, 0] = True
            for p in range(1, width):
                ok = (far[:, p] <= self.border * far[:, 0]) & (chosen.sum(axis=1) < self.replicas)
                chosen[:, p] = ok & ((between[:, p] >= far[:, p, None]) | ~chosen).all(axis=1)
            row, at = np.nonzero(chosen)
            parts.append((row + s, near[row, at], at == 0))
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`walk` as (distances, centroids)."""
        n = len(self.centroids)
        d = np.full(n, np.inf)
        seen, ahead = np.zeros(n, bool), np.zeros(n, bool)
        new = np.zeros(1, np.int64)
        narrow = True  # first to the nearest, then to all within ratio
        while True:
            d[new] = distances(q[None], self.centroids[new])[0]
            seen[new] = ahead[new] = True
            met = d[seen]
            edge = np.partition(met, WALK - 1)[WALK - 1] if len(met) > WALK else np.inf
            at = np.flatnonzero(ahead & (d <= edge))
            if not len(at):
                narrow = False
            if not narrow:
                at = np.flatnonzero(ahead & (d <= max(edge, self.ratio * met.min())))
            if not len(at):
                break
            ahead[at] = False
            fresh = np.zeros(n, bool)
            fresh[np.concatenate([self.graph[i] for i in at])] = True
            new = np.flatnonzero(fresh & ~seen)

        def taken(at: np.ndarray) -> tuple[np.ndarray, int, float]:
            at = at[np.argsort(d[at], kind="stable")]
            total = np.cumsum(self.held[at])
            return at, max(int(np.searchsorted(d[at], self.ratio * d[at[0]], "right")), int(np.searchsorted(total, self.k + 1)) + 1), total[-1]

        at, count, total = taken(np.flatnonzero(seen))
        if total < self.k + 1 and len(at) < n:
            d = distances(q[None], self.centroids)[0]
            at, count, _ = taken(np.arange(n))
        return d[at[:count]], at[:count]

    def walk(self, q: np.ndarray) -> list[tuple[float, int]]:
        """(distance, centroid), nearest first: all met within ``ratio`` of the nearest, and enough others."""
        far, at = self.reach(q)
        return list(zip(far.tolist(), at.tolist()))


def usable(col: Column) -> Column:
    number = F.transform(col, lambda x: x.cast("double"))
    bad = F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return col.isNotNull() & (F.size(col) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(number, lambda x: x != 0.0)


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles; as floats, if they come so."""
    kind = df.schema[embedding].dataType
    kind = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    v = F.transform(F.col(embedding), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    good = df.where(F.col(vec_id).isNotNull() & usable(F.col(embedding))).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    top = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("v") == top[0].n) if top else good


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its k + 1 smallest ids."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.dropDuplicates(["vec_id", "v"]).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def fit(entries: DataFrame, k: int = 5, sample: int = 20_000, list_size: int = 256, max_lists: int = 4096, border: float = 1.1, replicas: int = 4, recall: float = 0.97) -> Index | None:
    """An index over ``entries`` (v, ids); only the sample and one number for each list reach the driver."""
    total = entries.count()
    if not total:
        return None
    share = min(1.0, sample / total)
    some = entries.where(F.pmod(F.xxhash64(F.col("v").cast("array<double>")), F.lit(1_000_000)) < share * 1_000_000).orderBy(F.col("ids")[0]).select("v")
    got = some.limit(2 * sample).toArrow()
    x = unit(_matrix(got.column("v"))) if got.num_rows else unit(_matrix(entries.limit(1).select("v").toArrow().column("v")))
    lists = 1 << max(0, int(np.ceil(np.log2(max(1.0, min(max_lists, total / list_size, len(x) / 4))))))
    centroids = balanced_lists(x, lists)
    index = Index(k, centroids, neighbour_graph(centroids), border, replicas, held=np.full(len(centroids), float(k + 1)))
    rng = np.random.default_rng(3)
    queries = rng.choice(len(x), min(300, len(x)), replace=False)
    row, at, _ = index.assign(x)
    held_in = np.full((len(x), replicas), len(centroids))  # lists of each, and one that none is in
    held_in[row, np.arange(len(row)) - np.searchsorted(row, row)] = at
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -2.0
    true = np.argsort(-score, axis=1, kind="stable")[:, : min(k, max(0, len(x) - 1))]

    def recall_at(ratio: float) -> float:
        index.ratio, found = float(ratio), []
        for q, want in zip(queries, true):
            taken = np.zeros(len(centroids) + 1, bool)
            taken[index.reach(x[q])[1]] = True
            found.append(taken[held_in[want]].any(axis=1).mean() if len(want) else 1.0)
        return float(np.mean(found))

    ratios = np.arange(1.02, 2.0, 0.02)  # the least that reaches recall, as a wider walk finds no less; else the last
    low, high = 0, len(ratios) - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if recall_at(ratios[mid]) >= recall else (mid + 1, high)
    index.sample_recall = recall_at(ratios[low])
    return index


def binned(lists: np.ndarray, row: np.ndarray, n: int, bins: int, total: int) -> pa.Array:
    """``lists`` of ``n`` rows, of ``total`` in all, by bin: equal runs of consecutive lists, which lie near each other. ``row`` is ascending."""
    at = lists * bins // total
    order = np.lexsort((lists, at, row))
    row, at, lists = row[order], at[order], lists[order]
    start = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(at, prepend=-1)) if len(row) else np.zeros(0, np.int64)
    inner = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)), pa.int32()), pa.array(lists, pa.int32()))
    pairs = pa.StructArray.from_arrays([pa.array(at[start], pa.int32()), inner], ["bin", "lists"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[start], np.arange(n + 1)), pa.int32()), pairs)


def _member(col, lists: np.ndarray) -> np.ndarray:
    """Which of ``lists`` (ascending) each row holds."""
    out = np.zeros((len(col), len(lists)), bool)
    if len(lists):
        row, value = np.repeat(np.arange(len(col)), col.value_lengths().to_numpy(zero_copy_only=False)), col.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(lists, value), len(lists) - 1)
        there = lists[at] == value
        out[row[there], at[there]] = True
    return out


class Nearest:
    """The k nearest ids of each of some queries, over one block of entries after another."""

    def __init__(self, k: int, query_id: np.ndarray, q: np.ndarray, asked: np.ndarray):
        self.k, self.query_id, self.q, self.asked = k, query_id, q, asked
        self.short = unit(q).astype(np.float32)
        # products of unit vectors in single precision are off by less
        self.slack = (q.shape[1] + 8) * 2.0**-23
        self.score, self.id = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)

    def add(self, x: np.ndarray, ids: np.ndarray, first: np.ndarray, member: np.ndarray) -> None:
        """Entries: their vectors, the ids of entry i from ``first[i]`` to ``first[i + 1]``, and which lists each is in."""
        short = unit(x).astype(np.float32)
        rows = np.flatnonzero((self.asked & member.any(axis=0)).any(axis=1))
        shared = member.T.astype(np.float32)
        for s, e in slices(len(rows), len(x)):
            r = rows[s:e]
            score = self.short[r] @ short.T
            edge = self.score[r, -1] - self.slack
            few = np.flatnonzero(np.isneginf(edge))  # no k ids yet: k + 1 entries hold k other ids at least
            if len(few):
                score[few] = part = np.where(self.asked[r[few]].astype(np.float32) @ shared > 0, score[few], np.float32(-9))
                nth = max(0, len(x) - self.k - 1)
                edge[few] = np.maximum(np.partition(part, nth, axis=1)[:, nth] - 2 * self.slack, -8)
            self._merge(r, score >= edge.astype(np.float32)[:, None], x, ids, first, member)
            few = few[np.isneginf(self.score[r[few], -1])]
            if len(few):  # ids with several vectors among them
                self._merge(r[few], score[few] > -8, x, ids, first, member)

    def _merge(self, rows: np.ndarray, near: np.ndarray, x: np.ndarray, ids: np.ndarray, first: np.ndarray, member: np.ndarray) -> None:
        i, j = np.divmod(np.flatnonzero(near), len(x))
        i = rows[i]
        for s, e in slices(len(i), max(x.shape[1], member.shape[1])):
            self._compare(i[s:e], j[s:e], x, ids, first, member)

    def _compare(self, i: np.ndarray, j: np.ndarray, x: np.ndarray, ids: np.ndarray, first: np.ndarray, member: np.ndarray) -> None:
        there = (self.asked[i] & member[j]).any(axis=1)
        i, j = i[there], j[there]
        score = cosines(self.q[i], x[j])
        n = first[j + 1] - first[j]
        at = np.repeat(np.arange(len(j)), n)
        new = ids[first[j][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
        row, score = i[at], score[at]
        other = new != self.query_id[row]
        row, score, new = row[other], score[other], new[other]
        old = np.unique(row)
        row, score, new = np.concatenate([row, np.repeat(old, self.k)]), np.concatenate([score, self.score[old].ravel()]), np.concatenate([new, self.id[old].ravel()])
        held = ~np.isneginf(score)
        row, score, new = row[held], score[held], new[held]
        order = np.lexsort((-score, new, row))  # an id counts once, by its best vector
        row, score, new = row[order], score[order], new[order]
        best = np.ones(len(row), bool)
        best[1:] = (row[1:] != row[:-1]) | (new[1:] != new[:-1])
        row, score, new = row[best], score[best], new[best]
        order = np.lexsort((new, -score, row))
        row, score, new = row[order], score[order], new[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < self.k
        self.score[row[top], rank[top]], self.id[row[top], rank[top]] = score[top], new[top]

    def table(self) -> pa.Table:
        row, rank = np.nonzero(~np.isneginf(self.score))
        return pa.table({"query_id": pa.array(self.query_id[row], pa.int64()), "vec_id": pa.array(self.id[row, rank], pa.int64()), "score": pa.array(self.score[row, rank], pa.float64())})


def search(index: Index, entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found in ``entries`` (v, ids) for each of ``queries`` (vec_id, v)."""
    spark, k, lists = entries.sparkSession, index.k, len(index.centroids)
    width = index.centroids.shape[1]
    block_rows, block_queries = (max(1, min(n, BLOCK_VALUES // width)) for n in (BLOCK_ROWS, BLOCK_QUERIES))
    bins = min(lists, max(BINS, -(-entries.count() * index.replicas // block_rows)))
    shared = spark.sparkContext.broadcast(index)  # bounded by the lists

    def place():
        def run(v: pa.Array) -> list[pa.Array]:
            row, at, first = shared.value.assign(unit(_matrix(v)))
            return [pa.array(at[first], pa.int32()), binned(at, row, len(v), bins, lists)]

        return run

    new = T.StructType.fromDDL(f"home int, bins {BINNED}")
    placed = stored(with_arrow_columns(entries.select("ids", "v"), ["v"], new.fields, place), "posting-lists")
    held = np.zeros(lists)
    for r in placed.groupBy("home").agg(F.sum(F.size("ids")).alias("n")).collect():  # a row for each list
        held[r["home"]] = r["n"]
    index.held = held
    graph = spark.sparkContext.broadcast(index)

    def route(batches):
        for b in batches:
            for s, e in slices(b.num_rows, lists):
                part = b.slice(s, e - s)
                taken = [graph.value.reach(x)[1] for x in unit(_matrix(part.column("v")))]
                row = np.repeat(np.arange(len(taken)), [len(t) for t in taken])
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), binned(np.concatenate(taken), row, len(taken), bins, lists)], names=["query_id", "q", "bins"])

    kind = queries.schema["v"].dataType.simpleString()
    # few bytes but much work: as many tasks as partitions are set, which are not put together for their size
    asking = queries.select("vec_id", "v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id").dropDuplicates(["vec_id", "v"])
    routed = stored(in_tasks(asking, route, f"query_id long, q {kind}, bins {BINNED}"), "routed-queries")
    rows, asked = ({r["bin"]: r["count"] for r in df.select(F.explode("bins.bin").alias("bin")).groupBy("bin").count().collect()} for df in (placed, routed))  # a row for each bin
    cuts = [(j, -(-rows[j] // block_rows), -(-asked[j] // block_queries)) for j in sorted(rows.keys() & asked.keys())]
    if not cuts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cut = F.broadcast(spark.createDataFrame(cuts, "bin int, parts int, waves int"))  # a row for each bin
    left = placed.select("ids", "v", F.explode("bins").alias("b")).select("ids", "v", "b.*").join(cut, "bin")
    left = left.withColumn("part", F.pmod(F.xxhash64("v"), "parts").cast("int")).withColumn("wave", F.explode(F.sequence(F.lit(0), F.col("waves") - 1)))
    right = routed.select("query_id", "q", F.explode("bins").alias("b")).select("query_id", "q", "b.*").join(cut, "bin")
    right = right.withColumn("wave", F.pmod(F.xxhash64("query_id"), "waves").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b = a.combine_chunks(), b.combine_chunks()
        ours, asks, ids = (t.column(c).chunk(0) for t, c in ((a, "lists"), (b, "lists"), (a, "ids")))
        local = np.unique(ours.flatten().to_numpy(zero_copy_only=False))
        best = Nearest(k, b.column("query_id").to_numpy(), _matrix(b.column("q")), _member(asks, local))
        # entries of one list come together, so that queries which ask for none of a block's lists are passed over
        home = ours.flatten().to_numpy(zero_copy_only=False)[ours.offsets.to_numpy()[:-1] - ours.offsets[0].as_py()]
        order = np.argsort(home, kind="stable")
        for s, e in slices(len(order), max(width, len(local)), 1_024):
            at = pa.array(order[s:e])
            here = ids.take(at)
            best.add(_matrix(a.column("v").chunk(0).take(at)), here.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(here.value_lengths().to_numpy(zero_copy_only=False))), _member(ours.take(at), local))
        out = best.table()
        del a, b, best, ours, asks, ids
        release()
        return out

    keys = ["bin", "part", "wave"]
    pairs = left.select(*keys, "ids", "v", "lists").groupBy(keys).cogroup(right.select(*keys, "query_id", "q", "lists").groupBy(keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two matrices."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(cosines(a[None], b[None])[0])


def nearest(df: DataFrame, is_query: Column, k: int = 5, **options) -> DataFrame:
    """The k nearest rows of ``df`` (vec_id, embedding) of each row where ``is_query``, itself left out."""
    good = vectors(df)
    entries = stored(classes(good, k), "vector-classes")
    index = fit(entries, k, **options)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, entries, good.where(is_query))
