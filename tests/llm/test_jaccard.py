import random

import numpy as np
import pytest

from meshframes.llm import jaccard as jc
from meshframes.llm.components import components
from tests.llm.cases import documents, empty


def plain_sets(texts):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows, roots=False):
    """(doc_id, n_shingles, component) by comparing all pairs; or the group of each row."""
    sets = plain_sets(t for _, t in rows)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    if roots:
        return [find(i) for i in range(len(rows))]
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted(((d, len(s), names.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=220):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [r.choice(words) for _ in range(40)]
    base = [r.choice(words) for _ in range(90)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.5:  # near copies of one text, at about the limit
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = r.choice(words)
            w = w[: r.randrange(80, 91)]
        elif kind < 0.7:
            w = passage + [r.choice(words) for _ in range(r.randrange(12))]
        else:
            w = [r.choice(words) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 9, 30, 60]))]
        rows.append((i, r.choice([" ", "\n", "  ", "\t"]).join(x.upper() if r.random() < 0.1 else x for x in w)))
    rows += [(r.randrange(n), rows[r.randrange(n)][1]) for _ in range(15)] + [(None, rows[3][1]), (None, "x y z x y z q"), (None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block, least", [(0, 400, 64), (1, 20, 3), (2, 7, 2)])
def test_components_match_all_pairs(spark, monkeypatch, seed, block, least):
    monkeypatch.setattr(jc, "BLOCK_CLASSES", block)
    known = jc.frequent
    monkeypatch.setattr(jc, "frequent", lambda docs, total: known(docs, total, least))
    rows = corpus(seed)
    out = jc.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_deduplicate_keeps_the_smallest_of_each_group(spark):
    rows = corpus(5, 120)
    df = spark.createDataFrame([(d, t, "own", 1) for d, t in rows], "doc_id long, text string, cls string, root int")
    out = jc.deduplicate(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id for r in out.collect()), key=str)
    groups, blank = {}, []
    for (d, _), s, root in zip(rows, plain_sets(t for _, t in rows), brute(rows, roots=True)):
        groups.setdefault(root, []).append(d) if s else blank.append(d)
    want = blank + [min((d for d in g if d is not None), default=None) for g in groups.values()]
    assert got == sorted(want, key=str)


def test_sizes_at_the_limit():
    for n in range(1, 400):
        o = jc.overlap(n)
        assert 100 * o >= 80 * n > 100 * (o - 1) and 1 <= jc.floor_matches(n) <= o
        assert jc.least_matches(n) <= min(jc.floor_matches(m) for m in range(o, n * 100 // 80 + 1))


def test_prefixes_share_enough():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = x.copy()
        y[rng.random(len(x)) < rng.choice([0.0, 0.05, 0.1])] += np.uint64(1)
        y = np.unique(np.append(y, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 10))).astype(np.uint64)))
        some = np.unique(rng.choice(np.union1d(x, y), n // 3 + 1))
        known = jc.Frequent(some, rng.integers(2, 500, len(some)))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            (a, la), (b, lb) = jc.prefixes(x, known), jc.prefixes(y, known)
            shared = len(np.intersect1d(a, b))
            assert shared >= min(la, lb) and shared >= jc.least_matches(len(x))


def test_long_texts_hash_alike(monkeypatch):
    text = ("One two\tthree FOUR five six seven é\n" * 50).encode()
    whole = jc.shingle_sets([text, b"", b"a b", text])
    monkeypatch.setattr(jc, "CHUNK", 64)
    for a, b in zip(whole, jc.shingle_sets([text, b"", b"a b", text])):
        assert (a == b).all()


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = jc.near_duplicates(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)
    assert jc.near_duplicates(empty(spark)).count() == 0
    assert jc.deduplicate(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (None, 1)], "a long, b long")
    got = {r.a: r.b for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_a_task_gives_its_memory_back():
    import os

    from meshframes.llm.common import releasing

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    pins = []

    def task(batches):
        held = [b"x" * 50_000 for _ in range(4_000)]
        pins.extend(held[::400])  # pieces that stay lie between those that go
        yield len(held)

    before = resident()
    assert list(releasing(task)(iter([]))) == [4_000]
    assert resident() - before < 50_000_000
