import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from meshframes.llm import packing
from tests.conftest import SF_SMALL
from tests.llm.cases import documents, empty


def stats(ids, vocabulary=100):
    df = np.zeros(vocabulary)
    for x in ids:
        df[np.unique(x)] += 1
    idf = np.log1p((len(ids) - df + 0.5) / (df + 0.5))
    idf[2] = 0
    return packing.Statistics(idf, np.mean([len(x) for x in ids]), "<u2", 2)


def test_scores_are_bm25():
    rng = np.random.default_rng(0)
    ids = [np.append(rng.integers(3, 60, rng.integers(1, 30)), 2) for _ in range(40)]
    s = stats(ids)
    shard = packing.Shard(ids, s)
    for seed in (0, 7, 39):
        want = [sum(s.idf[t] * (f := (d == t).sum()) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / s.mean)) for t in np.unique(ids[seed])) for d in ids]
        assert np.allclose(shard.scores(seed), want)


def test_common_tokens_are_rows_and_the_unused_keep_their_scores():
    rng = np.random.default_rng(1)
    ids = [np.concatenate([rng.integers(3, 9, rng.integers(1, 30)), rng.integers(9, 95, 3), [2]]) for _ in range(40)]
    s = stats(ids)
    shard = packing.Shard(ids, s)
    common = {t for t in range(100) if t != 2 and packing.COMMON * sum(t in d for d in ids) >= len(ids)}
    assert common >= set(range(3, 9)) and len(shard.rows) == len(common)
    assert len(shard.doc) == sum(len(set(d.tolist()) - common - {2}) for d in ids)  # rare tokens alone have postings
    want = [shard.scores(seed) for seed in range(40)]
    used = np.zeros(40, bool)
    for some in (range(0, 40, 3), range(1, 40, 3), range(40)):
        used[list(some)] = True
        shard.forget(used)
        assert shard.rows.shape[1] == (~used).sum()
        for seed in range(40):
            got = shard.scores(seed)
            assert (got[~used] == want[seed][~used]).all() and not got[used].any()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([-1.0, 0.0, 0.5, 2.0, 3.0]), min_size=1, max_size=60))
def test_best_first_is_the_sorted_order(score):
    score = np.array(score)
    want = [i for i in np.argsort(-score, kind="stable").tolist() if score[i] >= 0]
    assert list(packing.best_first(score)) == want


@given(st.lists(st.integers(1, 40), min_size=1, max_size=10), st.sampled_from([100, 1 << 31]))
@settings(max_examples=50, deadline=None)
def test_postings_count_the_tokens_of_each_document(lengths, vocabulary):
    rng = np.random.default_rng(len(lengths))
    ids = [np.append(rng.integers(3, 20, n), [2, 99]).astype("<u2") for n in lengths]
    got = packing.postings(ids, vocabulary)
    assert list(zip(*(x.tolist() for x in got))) == [(i, t, d.tolist().count(t)) for i, d in enumerate(ids) for t in sorted(set(d.tolist()))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 150), min_size=1, max_size=30), st.integers(0, 1000))
def test_every_id_lies_in_one_piece_and_only_the_rest_is_cut(lengths, seed):
    rng = np.random.default_rng(seed)
    ids = [np.append(rng.integers(3, 100, n - 1), 2).astype(np.int64) for n in lengths]
    out = packing.pack_shard(ids, stats(ids), window=64)
    covered = defaultdict(list)
    for sequence in out:
        for doc, start, n in sequence:
            covered[doc] += range(start, start + n)
    assert {d: sorted(x) for d, x in covered.items()} == {d: list(range(n)) for d, n in enumerate(lengths)}
    sizes = [sum(n for *_, n in s) for s in out]
    full = sum(lengths) // 64
    assert sizes[:full] == [64] * full and all(x & (x - 1) == 0 for x in sizes)


def test_a_window_is_filled_by_the_neighbours_of_its_seed():
    topic = lambda base, n: np.append(np.arange(base, base + n), 2)
    ids = [topic(10, 20), topic(50, 20), topic(10, 21), topic(50, 21), topic(10, 19), topic(50, 19)]
    first = packing.pack_shard(ids, stats(ids), window=63)[0]
    assert {d for d, *_ in first} == {0, 2, 4}


def test_similarity_keys_tell_more_than_a_few_hundred_kinds_apart():
    rng = np.random.default_rng(3)
    ids = [np.append(rng.integers(3, 5000, 60), 2) for _ in range(6000)]
    sign, _ = packing.similarity_keys(ids, 5000)
    kinds, n = np.unique(sign, return_counts=True)
    assert len(kinds) > 2000 and n.max() < len(ids) / 256


def check(rows, docs, window=4096):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(zlib.crc32(np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for t in docs)
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id, r.doc_tokens].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window and (at == window or at & (at - 1) == 0)
    return want, by


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    texts = [r.text for r in docs.select("text").collect()]
    want, by = check(rows, texts)
    got = []
    for (_, n), parts in by.items():
        ids = b"".join(bytes(p.ids) for p in sorted(parts, key=lambda p: p.start))
        assert len(ids) == 4 * n
        got.append(zlib.crc32(ids))
    assert sorted(got) == want


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 3)
    docs = documents(spark)
    out = packing.digest(packing.pack_documents(docs))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = out.collect()
    check(rows, [])
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert sum(r.start == 0 for r in rows) == 15
    assert sorted(r.doc_tokens for r in rows if r.start == 0)[:4] == [1, 1, 1, 1]
    assert packing.pack_documents(empty(spark)).count() == 0
