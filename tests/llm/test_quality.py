import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from meshframes.llm import quality
from tests.llm.cases import documents, empty


def plain(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(wins)
    hit = {i + j for i, w in enumerate(wins) if many[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|é\n\t\x0b\x1c\xa0 ", max_size=60))
def test_statistics_match_plain_version(text):
    assert quality.text_stats(text.encode())[:5] == plain(text)


def test_numbered_windows_agree(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [("a b c d e f g a b c d e x y z a b c d e " * 3).encode().split(), *([b"%d" % x for x in rng.integers(0, 3, n)] for n in (6, 40, 900))]
    exact = [quality._repeat_words(words) for words in texts]
    monkeypatch.setattr(quality, "NUMBERED_WORDS", 3)
    assert [quality._repeat_words(words) for words in texts] == exact and exact[0] > 0


def test_path_lengths_match_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    f = quality.grow(x, np.ones(300, bool), trees=5, subsample=64)
    e = (x - f.middle) / f.spread

    def walk(row):
        total = 0.0
        for node in f.roots:
            while f.feature[node] >= 0:
                node = f.left[node] + (row[f.feature[node]] >= f.value[node])
            total += f.path[node]
        return 2 ** (-total / 5 / float(quality.expected_path(64)))

    assert np.allclose(f.score(x), [walk(r) for r in e])


def test_what_lies_beyond_the_good_documents_has_the_shorter_paths():
    rng = np.random.default_rng(4)
    good = rng.normal(size=(5000, 4)) * [1, 10, 0.1, 1] + [5, 0, 1, 0]
    f = quality.grow(good, np.ones(len(good), bool))
    middle, spread = good.mean(axis=0), good.std(axis=0)
    far = np.array([middle + spread * d for d in ([9, 0, 0, 0], [0, -9, 0, 0], [0, 0, 30, 0], [4, 4, -4, 4])])
    assert f.score(far).min() > f.score(good).max()
    # no range of a single rate tells the last one: each of its rates is met among good documents
    assert (np.abs(far[3] - middle) < np.abs(good - middle).max(axis=0) + 0.8 * spread).all()
    # junk of one kind among the labelled documents does not hide itself
    mixed = np.vstack([good, np.tile(far[0], (2000, 1))])
    g = quality.grow(mixed, np.arange(len(mixed)) < len(good))
    assert g.score(far[:1])[0] > g.score(good).max()


def test_cut_maximises_gain():
    good, bad = np.zeros(quality.BINS, int), np.zeros(quality.BINS, int)
    good[1000], good[9000], bad[6000], bad[500] = 99, 1, 50, 1
    assert 0.1 < quality.calibrate(good, bad, 5.0) <= 0.6
    assert quality.calibrate(good, bad * 0, 5.0) == np.inf


def test_labelled_junk_goes_and_clean_text_stays(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(300):
        words = list(rng.choice(vocabulary, 60))
        junk = i % 10 == 0
        rows.append((i, " ".join(w + "###" if junk else w for w in words), "en", "a"))
        labels.append((i, int(not junk), 0))
    docs = documents(spark, rows)
    forest = quality.fit(docs, spark.createDataFrame(labels[:250], "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r.kept for r in quality.judge(docs, forest).collect()}
    assert all(out[i] == (i % 10 != 0) for i in range(300))


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, quality.fit(docs, labels)).select("doc_id", "text", *quality.STATS[:5], "base_failed", "kept", "lang").collect()
    assert len(out) == 15
    for r in out:
        want = plain(r.text)
        assert tuple(r[2:7]) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.judge(empty(spark), None).count() == 0
