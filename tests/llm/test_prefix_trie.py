import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meshframes.llm import prefix_trie as pt

ROWS = "conv_id long, turn int, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def said(role, text):
    return sha(f"{len((role or '').encode())}:{role or ''}{text or ''}")


def conversations(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            out[c].append(((t is not None, t or 0), said(r, x), r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of every node, by following each prefix."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        gain = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += gain
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))))
        for p, m in members.items()
    )


def frame(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    for c in ("depth", "k1", "what", "pos", "n", "band", "held", "row", "bytes"):
        df = df.withColumn(c, F.lit("own"))
    return df


def digest(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns[:8] == cols
    return sorted(map(tuple, df.select(cols).collect()), key=lambda r: (r[0], r[1]))


def made(n, seed, turns=6, texts="ab"):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]), r.choice([*texts, "é\U0001f600", "", None])) for c in range(-7, n) for t in range(r.randint(1, turns))]


AWKWARD = [
    (1, None, "user", "b"), (1, None, "user", "a"), (1, 0, None, None), (1, 0, None, None), (1, 5, "user", "x" * 50_000), (2, 1, "us", "era"), (3, 1, "user", "a"), (3, 1, "use", "ra"),
    (4, 0, "user", "a"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 3, "", ""), (None, 0, "user", "a"), (None, None, None, None), (-3, 0, "user", "a"), (0, 0, "1:", "a"), (6, 0, "", "1:a"),
]


@pytest.mark.parametrize("rows", [AWKWARD, made(60, 1), made(25, 2, 30, "a")], ids=["awkward", "wide", "deep"])
def test_against_brute_force(spark, rows):
    turns = pt.ordered(frame(spark, rows))
    want = sorted(plain(rebuilt(conversations(rows))), key=lambda r: r[:2])
    assert digest(pt.trie(*pt.borrowed(turns))) == want
    assert digest(pt.of_conversations(frame(spark, rows))) == sorted(plain(conversations(rows)), key=lambda r: r[:2])


@pytest.mark.parametrize("height", [2, 3, 5])
def test_bands_of_any_height(spark, height):
    rows = [(c, t, "u", "same" if t < 20 + c else f"t{t % 3}") for c in range(4) for t in range(33 - 3 * c)] + made(8, 3, 12, "a")
    got = pt.of_conversations(frame(spark, rows), height=height)
    assert digest(got) == sorted(plain(conversations(rows)), key=lambda r: r[:2])


def test_long_conversations_are_cut(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 7)
    monkeypatch.setattr(pt, "IDS", 3)
    rows = [(c, t, "u", f"t{t % 5}") for c in (1, 2, 3) for t in range(100 if c < 3 else 60)] + [(c, 0, "u", "t0") for c in range(10, 50)]
    got = pt.of_conversations(frame(spark, rows).repartition(5), height=4)
    assert digest(got) == sorted(plain(conversations(rows)), key=lambda r: r[:2])


def test_numbering_over_partitions(spark):
    """One conversation holds most rows, most of them alike: they are still dealt over all partitions."""
    rows = [(7, None, "u", "same")] * 3000 + [(7, t, "u", f"t{t}") for t in range(500)] + [(c, t, "u", "x") for c in range(20) for t in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        got = pt.ordered(frame(spark, rows))
        by = defaultdict(list)
        for r in got.collect():
            by[r.conv_id].append(r.pos)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(by[7]) == list(range(1, 3504)) and all(sorted(v) == [1, 2, 3] for c, v in by.items() if c != 7)


def test_texts_of_nodes(spark):
    got = pt.of_conversations(frame(spark, AWKWARD)).select("conv_id", "depth", "role", "text").collect()
    convs = conversations(AWKWARD)
    for r in got:
        assert (r.role, r.text) == (convs[r.conv_id][r.depth - 1] if r.depth else (None, None))


def test_empty_table(spark):
    df = frame(spark, AWKWARD).where("false")
    assert pt.of_conversations(df).count() == 0 and pt.trie(*pt.borrowed(pt.ordered(df))).count() == 0
