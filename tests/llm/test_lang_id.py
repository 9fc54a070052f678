import numpy as np

from meshframes.llm import lang_id
from tests.conftest import SF_SMALL
from tests.llm.cases import documents, empty


def test_grams_match_plain_version():
    texts = ["La, LA!", "", "a", "x" * 5, "déjà vu"]

    def codes(s):
        c = np.array([ord(x) for x in s], np.uint64)
        if len(c) == 3:
            return int(lang_id.mix((c[:1] << np.uint64(42)) | (c[1:2] << np.uint64(21)) | c[2:])[0])
        p = (c[:1] << np.uint64(42)) | (c[1:2] << np.uint64(21)) | c[2:3]
        return int(lang_id.mix(p * lang_id.MUL_A + c[3:] * lang_id.MUL_B + np.uint64(4))[0])

    h, doc, has = lang_id.grams(texts)
    assert has.tolist() == [True, False, True, True, True]
    for i, t in enumerate(texts):
        s = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + " "
        want = sorted(codes(s[j : j + n]) for n in (3, 4) for j in range(len(s) - n + 1) if " " not in s[j + 1 : j + n - 1])
        assert sorted(h[doc == i].tolist()) == (want if s.strip() else [])


def test_filter_holds_all_it_was_given_and_few_others():
    rng = np.random.default_rng(0)
    sets = {f"l{i:02d}": rng.integers(0, 2**63, 500).astype(np.uint64) for i in range(70)}
    m = lang_id.build(sets, {k: 1 for k in sets})
    assert len(m.cells) == 2
    for i, (k, g) in enumerate(sorted(sets.items())):
        mask = m.masks(g)[i // 64]
        assert ((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)).all()
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    hit = (m.masks(other)[0] & np.uint64(1)).mean()
    assert abs(hit - m.fp[0]) < 0.02 and m.fp[0] < 0.1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = lang_id.detect(docs.withColumn("held_out", lang_id.held_out()), lang_id.fit(docs)).where("held_out and lang is not null").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95


def test_held_out_rows_and_their_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    lied = docs.withColumn("lang", lang_id.F.when(lang_id.held_out(), "xx").otherwise(lang_id.F.col("lang")))
    a, b = lang_id.fit(docs), lang_id.fit(lied)
    assert a.languages == b.languages and all((x == y).all() for x, y in zip(a.cells, b.cells))


def test_awkward_rows(spark):
    docs = documents(spark)
    out = lang_id.detect(docs, lang_id.fit(docs)).collect()
    assert len(out) == 15
    for r in out:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert r.kept == "own"
    nothing = lang_id.fit(empty(spark))
    assert nothing.languages == []
    assert {r.lang_pred for r in lang_id.detect(docs, nothing).collect()} == {"und"}
    assert lang_id.detect(empty(spark), nothing).count() == 0
