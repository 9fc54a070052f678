import math
import tracemalloc

import numpy as np

from meshframes.llm import ann
from pyspark.sql import functions as F


def brute(rows, is_query, k=5):
    """The k nearest of each query by plain loops."""
    good = {}
    size = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            size[len(v)] = size.get(len(v), 0) + 1
            good.setdefault(i, []).append([float(np.float32(x)) for x in v])
    most = min(size, key=lambda n: (-size[n], n)) if size else 0
    flat = [(i, v) for i, vs in good.items() for v in {tuple(x) for x in vs if len(x) == most}]
    out = {}
    for i, v in flat:
        if is_query(i):
            found = {}
            for j, w in flat:
                if j != i:
                    found[j] = max(found.get(j, -2), ann.cosine(np.array(v), np.array(w)))
            out[i] = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def run(df, mod=10, **options):
    rows = ann.nearest(df, F.col("vec_id") % mod == 0, **options).orderBy("query_id", "rank").collect()
    out = {}
    for r in rows:
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = run(df, list_size=50), brute(rows, lambda i: i % 10 == 0)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hit = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hit / (5 * len(want)) >= 0.9
    scores = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - scores[q].get(j, s)) < 1e-12 for q, v in got.items() for j, s in v)


def test_small_blocks_copies_and_awkward_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).astype(np.float32).tolist()) for i in range(200)]
    rows += [(300, None), (301, [0.0] * 4), (302, [None, 1.0, 1.0, 1.0]), (303, [float("nan")] * 4), (304, [float("inf"), 1.0, 1.0, 1.0]), (305, [1.0, 2.0]), (None, [1.0] * 4), (306, [])]
    rows += [(0, [1.0, 2.0, 3.0, 4.0])] * 2 + [(310, [2.0, 4.0, 6.0, 8.0]), (320, [1e38, 1e38, 1e38, 1e38])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as list", "2 as q", "'own' as ids", "3 as rank")
    want = brute(rows, lambda i: i % 10 == 0)
    assert run(df, list_size=20, recall=1.1).keys() == want.keys()
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    got = run(df, max_lists=1)  # one list: exact
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert run(spark.createDataFrame([], schema)) == {}
    assert run(spark.createDataFrame([(0, [1.0, 0.0])], schema)) == {}
    got = run(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], schema))
    assert [j for j, _ in got[0]] == [1, 2]
    assert run(spark.createDataFrame([(1, [1.0, 0.0])], schema)) == {}


def test_lists_are_balanced_and_the_graph_is_whole():
    x = ann.unit(np.random.default_rng(2).normal(size=(640, 8)))
    c = ann.balanced_lists(x, 64)
    graph = ann.neighbour_graph(c)
    seen, todo = {0}, [0]
    while todo:
        for j in graph[todo.pop()].tolist():
            if j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(c) == 64 and len(seen) == 64
    index = ann.Index(5, c, graph, 1.1, 4, held=np.full(64, 10.0))
    hits = sum(index.walk(q)[0][1] == int(np.argmin(ann.distances(q[None], c)[0])) for q in x[:200])
    assert hits >= 196


def plain_assign(index, x):
    """Lists of each vector by loops over all centroids."""
    between = ann.distances(index.centroids, index.centroids)
    out = []
    for i, far in enumerate(ann.distances(x, index.centroids)):
        near = np.argsort(far, kind="stable")[: 4 * index.replicas].tolist()
        chosen = near[:1]
        for j in near[1:]:
            if far[j] > index.border * far[near[0]] or len(chosen) == index.replicas:
                break
            if all(between[j, c] >= far[j] for c in chosen):
                chosen.append(j)
        out += [(i, j, n == 0) for n, j in enumerate(chosen)]
    return out


def test_lists_of_vectors_and_queries_as_by_plain_loops(monkeypatch):
    rng = np.random.default_rng(4)
    x = ann.unit(rng.normal(size=(400, 8)))
    for lists in (1, 2, 64):
        c = ann.balanced_lists(x, lists)
        index = ann.Index(5, c, ann.neighbour_graph(c), 1.3, 4, ratio=1.4, held=np.full(lists, 3.0))
        want = plain_assign(index, x)
        assert list(zip(*(a.tolist() for a in index.assign(x)))) == want
        with monkeypatch.context() as m:
            m.setattr(ann, "ARRAY_VALUES", 100)
            assert list(zip(*(a.tolist() for a in index.assign(x)))) == want
            assert all(np.array_equal(a, b) for a, b in zip(ann.neighbour_graph(c), index.graph))
        for q in x[:50]:
            far = ann.distances(q[None], c)[0]
            near = np.argsort(far, kind="stable").tolist()
            got = index.walk(q)
            assert [j for _, j in got] == [j for n, j in enumerate(near) if far[j] <= 1.4 * far[near[0]] or 3 * n < 6]
            assert all(abs(d - far[j]) < 1e-12 for d, j in got)


def test_memory_does_not_grow_with_lists_times_rows():
    rng = np.random.default_rng(5)
    x, c = ann.unit(rng.normal(size=(4_000, 64))), ann.unit(rng.normal(size=(4_096, 64)))
    tracemalloc.start()
    try:
        index = ann.Index(5, c, ann.neighbour_graph(c), 1.1, 4)
        index.assign(x)
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()


def test_vectors_and_queries_are_kept_once_whatever_their_lists(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    kept = {}

    def stored(df, name, write=ann.stored):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(ann, "stored", stored)
    run(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), list_size=20)
    assert kept["routed-queries"].count() == 150 and kept["posting-lists"].count() == 1500
    assert dict(kept["posting-lists"].dtypes)["v"] == dict(kept["routed-queries"].dtypes)["q"] == "array<float>"
    lists = kept["routed-queries"].select(F.sum(F.aggregate("bins", F.lit(0), lambda n, b: n + F.size(b["lists"])))).first()[0]
    assert lists > 1500  # many for each


def test_blocks_find_what_all_pairs_of_common_lists_give():
    rng = np.random.default_rng(7)
    k = 3
    x = np.concatenate([rng.normal(size=(60, 6)), 1 + 1e-10 * rng.normal(size=(60, 6)), np.outer(rng.integers(1, 9, 40), np.ones(6))])
    q = np.concatenate([rng.normal(size=(10, 6)), 1 + 1e-10 * rng.normal(size=(10, 6)), np.ones((2, 6))])
    ids = [sorted(rng.choice(120, rng.integers(1, k + 2), replace=False).tolist()) for _ in x]  # an id has several vectors
    member, asked = rng.random((len(x), 5)) < 0.4, rng.random((len(q), 5)) < 0.4
    best = ann.Nearest(k, np.arange(len(q)), q, asked)
    for s in range(0, len(x), 16):
        part = ids[s : s + 16]
        best.add(x[s : s + 16], np.concatenate(part), np.append(0, np.cumsum([len(p) for p in part])), member[s : s + 16])
    got = {}
    for r in best.table().to_pylist():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for i in range(len(q)):
        found = {}
        for j in range(len(x)):
            if (asked[i] & member[j]).any():
                for v in set(ids[j]) - {i}:
                    found[v] = max(found.get(v, -2), ann.cosine(q[i], x[j]))
        assert got.get(i, []) == sorted(found.items(), key=lambda z: (-z[1], z[0]))[:k]


def test_doubles_are_compared_as_doubles(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (1 + 1e-10 * rng.normal(size=4)).tolist()) for i in range(120)]
    flat = [(i, np.array(v)) for i, v in rows]
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), max_lists=1)
    for i, v in flat[::10]:
        want = sorted(((-ann.cosine(v, w), j) for j, w in flat if j != i))[:5]
        assert [(j, -s) for s, j in want] == got[i]
