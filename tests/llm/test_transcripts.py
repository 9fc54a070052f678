import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from meshframes.llm import transcripts as tr
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("line, role, rest", [
    ("User: hi", "user", "hi"), ("**Assistant:** yes", "assistant", "yes"), ("### System", "system", ""), ("<|user|> x", "user", "x"), ("[ASSISTANT]: y", "assistant", "y"),
    ("> Q: z", "user", "z"), ("plain", "", "plain"), ("a cat: no", "", "a cat: no"), ("username: no", "", "username: no"), ("", "", ""),
])
def test_markers(line, role, rest):
    assert tr.read_line(line) == (role, rest)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10_000))
def test_viterbi_matches_brute_force_and_blocks(n, seed):
    rng = np.random.default_rng(seed)
    moves = [np.vstack([rng.normal(size=(3, 3)), rng.normal(size=(1, 3))]) for _ in range(n)]
    start = tr.only(4, 3)
    best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(m[a, b] for m, a, b in zip(moves, (3, *p), p)))
    assert tr.viterbi(start, moves, np.zeros(4)) == list(best)
    whole = moves[0]
    for m in moves[1:]:
        whole = tr.max_plus(whole, m)
    assert np.isclose(whole[3].max(), sum(m[a, b] for m, a, b in zip(moves, (3, *best), best)))


def test_cutting_into_blocks_changes_nothing(spark, monkeypatch):
    messages = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    model = tr.fit(messages)
    one = sorted(tr.parse(messages, model).select("conv_id", "turn", "part", "role_pred", "rendered").collect())
    monkeypatch.setattr(tr, "BLOCK", 2)
    assert sorted(tr.parse(messages, model).select("conv_id", "turn", "part", "role_pred", "rendered").collect()) == one


def test_held_out_accuracy_without_the_role(spark):
    messages = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").withColumn("held_out", tr.held_out())
    model = tr.fit(messages)
    out = tr.parse(messages, model).where("held_out").toPandas()
    assert (out.role == out.role_pred).mean() > 0.85
    blind = tr.parse(messages.withColumn("role", tr.F.lit("nobody")), model).select("conv_id", "turn", "role_pred").collect()
    assert sorted(blind) == sorted(tr.parse(messages, model).select("conv_id", "turn", "role_pred").collect())


def test_markers_decide_and_split_a_message(spark):
    rows = [(1, 0, None, "System: be kind\nUser: hello\nhow are you?\nAssistant: fine\nthanks"), (2, 0, None, "hello"), (2, None, None, None), (None, 1, None, " \n "), (None, 1, None, " \n ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'own' as part", "1 as enter", "'own' as content", "2 as block")
    model = tr.fit(df)
    out = tr.parse(df, model)
    assert set(out.columns) == {"conv_id", "turn", "role", "text", "enter", "block", "part", "role_pred", "content", "rendered"}
    got = out.orderBy("conv_id", "turn", "part").collect()
    assert [(r.role_pred, r.content) for r in got if r.conv_id == 1] == [("system", "be kind"), ("user", "hello\nhow are you?"), ("assistant", "fine\nthanks")]
    assert got[-1].rendered and len(got) == 7 and sum(r.conv_id is None for r in got) == 2
    assert all(r.rendered == f"<|{r.role_pred}|>\n{r.content}<|end|>" for r in got)
    assert tr.parse(df.limit(0), tr.fit(df.limit(0))).count() == 0
