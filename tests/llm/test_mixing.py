from collections import defaultdict

import pytest

from meshframes.llm import mixing
from meshframes.llm.common import stored
from tests.conftest import SF_SMALL
from tests.llm.cases import documents, empty


def edf(shares):
    """Earliest deadline first, slot by slot."""
    p, done, out = sum(shares), [0] * len(shares), []
    for t in range(p):
        free = [(-(-(n + 1) * p // c), i) for i, (n, c) in enumerate(zip(done, shares)) if n * p // c <= t]
        out.append(min(free)[1])
        done[out[-1]] += 1
    return out


@pytest.mark.parametrize("shares", [[1], [5, 3, 2], [1, 1, 1, 7], [13, 13, 1, 2, 31], [2] * 9])
def test_period_is_edf_and_stays_within_a_block(spark, shares):
    weights = spark.createDataFrame([(f"s{i:02d}", c) for i, c in enumerate(shares)], "source string, weight long")
    rows = mixing.period(weights, sum(shares)).orderBy("source").collect()
    assert [r.share for r in rows] == shares
    picks = [None] * sum(shares)
    for i, r in enumerate(rows):
        for t in r.slot_of:
            picks[t] = i
    assert picks == edf(shares)
    for i, c in enumerate(shares):
        for t in range(len(picks) + 1):
            assert abs(picks[:t].count(i) - t * c / sum(shares)) < 1


def test_streams_blocks_and_end_match_plain_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    weights = spark.createDataFrame([(f"src{i}", 1 + i % 3) for i in range(20)], "source string, weight long")
    out = mixing.mix(docs, weights, slots=40, block_chars=3000).collect()
    assert len(out) == docs.count() and len({r.doc_id for r in out}) == len(out)
    taken = defaultdict(set)
    for r in out:
        taken[r.slot].add(r.source)
    assert all(len(s) == 1 for s in taken.values())
    chars, where = defaultdict(int), defaultdict(set)
    for r in out:
        chars[r.source] += len(r.text)
        where[r.source].add(r.block)
    for s, n in chars.items():
        assert min(where[s]) == 0 and max(where[s]) <= max(0, n - 1) // 3000
    shares = {r.source: r.share for r in mixing.period(weights, 40).collect()}
    p, total = sum(shares.values()), sum(chars.values())
    picks = edf([shares[s] for s in sorted(shares)])
    slots = {s: [t for t, i in enumerate(picks) if sorted(shares)[i] == s] for s in shares}
    slot = lambda s, b: b // shares[s] * p + slots[s][b % shares[s]]
    assert all(r.slot == slot(r.source, r.block) for r in out)
    end = max(slot(s, -(-chars[s] // 3000) - 1) for s in shares if shares[s] / p >= chars[s] / total) + 1
    assert all(r.mixed == (r.slot < end) for r in out) and not all(r.mixed for r in out)


def test_buckets_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    weights = mixing.capped_weights(mixing.source_sizes(docs))
    one = sorted(mixing.mix(docs, weights, block_chars=2000).select("doc_id", "block", "slot", "mixed").collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    assert sorted(mixing.mix(docs, weights, block_chars=2000).select("doc_id", "block", "slot", "mixed").collect()) == one


def test_cap(spark):
    sizes = spark.createDataFrame([("a", 1, 600), ("b", 1, 200), ("c", 1, 150), ("d", 1, 50)], "source string, docs long, chars long")
    got = {r.source: r.weight for r in mixing.capped_weights(sizes, 0.25).collect()}
    assert got == {"a": 133, "b": 200, "c": 150, "d": 50} and 0.24 < 133 / sum(got.values()) <= 0.25
    one = {r.source: r.weight for r in mixing.capped_weights(sizes.where("source = 'a'"), 0.25).collect()}
    assert one == {"a": 600}


def test_native_plan(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = mixing.mix(docs, mixing.capped_weights(mixing.source_sizes(docs)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_awkward_rows(spark):
    docs = documents(spark)
    sizes = stored(mixing.source_sizes(docs), "sizes-test")
    out = mixing.mix(docs, mixing.capped_weights(sizes), sizes, block_chars=500)
    assert out.count() == 15 and set(out.columns) == set(docs.columns)
    assert out.where("slot is null").count() == 2  # the null source has two rows without characters, and so no weight
    some = mixing.mix(docs, spark.createDataFrame([("a", 1), ("b", 0)], "source string, weight long"), block_chars=500).collect()
    assert all((r.slot is None) == (r.source != "a") and (r.source == "a" or not r.mixed) for r in some)
    none = empty(spark)
    assert mixing.mix(none, mixing.capped_weights(mixing.source_sizes(none))).count() == 0
