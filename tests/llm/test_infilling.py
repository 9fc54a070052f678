import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from meshframes.llm import infilling as fim
from tests.llm.cases import documents, empty

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(doc_id, text):
    """The contract, word for word, on Python's code points."""
    text = text or ""
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = st.text(alphabet=st.sampled_from("ab \t\n\x0b\x1c\x85\xa0é\U0001f600<PSM>"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(-5, 400))
def test_cut_as_the_contract_says(text, doc_id):
    n, form, p, m, out = fim._cut(doc_id, text.encode(), 50, 80, 42)
    assert (n, form, p, m, out.decode()) == plain(doc_id, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=40), st.integers(2, 5))
def test_descent_reaches_every_rank(parts, span):
    fim.SPAN, old = span, fim.SPAN
    try:
        text = "".join(parts)
        units = UNIT.findall(text)
        s = fim.SkipList(np.frombuffer(text.encode(), np.uint8))
        assert s.units == len(units)
        for r in range(len(units) + 1):
            first = "".join(units[:r])
            assert s.descend(r) == (len(first), len(first.encode()))
    finally:
        fim.SPAN = old


def test_descent_is_short_on_a_long_text():
    text = ("wört x\n" * 200_000).encode()
    s = fim.SkipList(np.frombuffer(text, np.uint8))
    assert len(s.lanes) > 3
    # every lane above the lowest is thinner, and links of a lane cover all units
    sizes = [len(w) for _, w in s.lanes]
    assert all(b < a / 8 for a, b in zip(sizes, sizes[1:]) if a > 1000)
    for rank in (0, 1, 123_456, 399_999, 400_000):
        s.steps = 0
        chars, size = s.descend(rank)
        assert s.steps < 600 and chars == len(text[:size].decode())


def test_transform(spark):
    rows = [(i, t, None, None) for i, t in enumerate(["a b c d e f g", " lead", "trail \n", "x", "has <S> mark", "é \U0001f600  ü\x0bz", "", None] * 12)]
    rows += [(None, "no id here", None, None), (3, "repeated row", None, None), (3, "repeated row", None, None), (77, "lang " * 60_000, None, None)]
    docs = documents(spark, rows).selectExpr("*", "'own' as form", "'own' as output", "'own' as _text", "'own' as n2")
    got = fim.transform(docs, keep=["doc_id", "form", "lang", "n2"])
    assert got.columns == ["doc_id", "lang", "n2", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = sorted(((i, *plain(i, t)) for i, t, _, _ in rows), key=str)
    assert sorted(map(tuple, got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=str) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    back = got.withColumn("text", fim.restored(F.col("output"), F.col("form"))).select("doc_id", "text")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t or "") for i, t, _, _ in rows), key=str)
    dig = {tuple(r) for r in fim.digest(got).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert dig == {(i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t or "")) for i, t, _, _ in rows}


def test_other_parameters_and_empty_table(spark):
    assert fim.transform(empty(spark)).count() == 0
    docs = documents(spark, [(i, "one two three", None, None) for i in range(50)])
    assert {r.form for r in fim.transform(docs, rate=100, suffix_first=0).collect()} == {"psm"}
    assert {r.form for r in fim.transform(docs, rate=0).collect()} == {"plain"}


def test_bytes_that_are_no_text_pass(spark):
    docs = spark.sql("select cast(id as long) doc_id, cast(unhex('61FF20C3') as string) text from range(40)")
    got = fim.transform(docs).select(F.hex(F.col("output").cast("binary")).alias("x"), "n").collect()
    assert len(got) == 40 and all(r.n == 2 and "61FF" in r.x and "20C3" in r.x for r in got)
