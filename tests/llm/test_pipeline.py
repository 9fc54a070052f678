import __spark_entry__ as E
import corpus_pipeline as cp
from meshframes.llm import mixing
from meshframes.session import scratch_path
from tests.conftest import SF_SMALL
from tests.llm.cases import documents, empty
from tests.llm.test_jaccard import plain_sets
from tests.llm.test_quality import plain


def test_stages_by_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language ID", "quality rules", "near-duplicate join", "source mixing", "retrieval packing"]
    seen = [docs]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, seen[-1], SF_SMALL)
        assert out.columns == docs.columns
        seen.append(out.cache())
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(a >= b for a, b in zip(ids, ids[1:]))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(any(c.isalpha() for c in texts[i]) for i in ids[1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    for i in ids[1]:
        n, _, _, _, repeat = plain(texts[i])
        assert not (i in ids[2] and (n < 10 or 100 * repeat > 20 * n))
    assert sum(labels[i] == 1 for i in ids[1] - ids[2] if i in labels and plain(texts[i])[0] >= 10 and not plain(texts[i])[4]) <= 1
    order = sorted(ids[2])
    sets = dict(zip(order, plain_sets(texts[i] for i in order)))
    up = {i: i for i in order}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in order:
        for j in order:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert ids[3] == {i for i in order if find(i) == i}
    pieces = cp.STAGES[-1][1](spark, seen[-1], SF_SMALL).collect()
    assert {r.doc_id for r in pieces} == ids[4]
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_mixing_keeps_every_document(spark):
    rows = [(i, "wort " * 4000, "de", "hot" if i % 3 == 0 else f"s{i % 7}", 20_000) for i in range(240)]
    rows += [(240, "", "de", "blank", 0), (241, None, None, None, 0), (3, "wort", "de", "hot", 4), (3, "wort", "de", "hot", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.mixture(spark, docs, SF_SMALL).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    # all of the hot source's surplus and what has no slot lies after the rest
    mixed = mixing.mix(docs, mixing.capped_weights(mixing.source_sizes(docs), cp.MAX_SHARE)).collect()
    assert sum(r.slot is None for r in mixed) == 2 and sum(not r.mixed and r.source == "hot" for r in mixed) > 20
    slots = {r.doc_id: r.slot for r in mixed if r.doc_id != 3}
    order = [slots[r.doc_id] for r in out if r.doc_id != 3]
    assert order == sorted(order, key=lambda x: (x is None, x))


def test_registered():
    queries, sql = E.queries(), E.oracle_sql()
    assert "pipeline" in queries
    assert sorted(int(n[2:].split("_")[0]) for n in queries if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert {"op3_source_mixing", "op4_url_filter", "op11_capture_index", "op12_prefix_trie", "op13_fill_in_middle"} <= set(sql)


def test_awkward_and_empty_tables_through_all_stages(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for docs, known in ((documents(spark), labels), (empty(spark), labels.limit(0))):
        sf = scratch_path(spark, "pipeline-test")
        docs.write.parquet(f"{sf}/documents.parquet")
        known.write.parquet(f"{sf}/labels.parquet")
        rows = cp.run(spark, sf).collect()
        assert all(r.length > 0 and 0 <= r.start < r.doc_tokens for r in rows)
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
        assert bool(rows) == bool(docs.count())


def test_sequences_follow_the_mixture(spark):
    rows = [(i, f"wort{i % 97} " * 900, "de", "hot" if i % 3 == 0 else f"s{i % 7}", 7_200) for i in range(120)] + [(None, "ohne", "de", "s1", 4), (7, "sieben", "de", "s0", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = cp.stored(cp.mixture(spark, docs, SF_SMALL), "mixture-test")
    order = {}
    for r in cp.mixture(spark, docs, SF_SMALL).collect():
        order.setdefault(r.doc_id, len(order))
    place = {r.doc_id: r.place for r in cp.placed(mixed).collect()}
    assert sorted(place, key=place.get) == sorted(order, key=order.get)
    pieces = cp.sequences(spark, mixed, SF_SMALL).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    members = {}
    for r in pieces:
        members.setdefault((r.sequence_id, r.mix_place), set()).add(r.doc_id)
    assert len({s for s, _ in members}) == len(members)
    assert all(at == min(place[i] for i in ids) for (_, at), ids in members.items())
