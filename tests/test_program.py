"""Per-frame programs (FIXTURES 1.4) and their error rule."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meshframes.operators.program import Each, Path, Program, ProgramError, Project, Reshape, Select, program_errors, run_program


def _run(spark, program, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "source int, doc string").withColumn("sequence", F.lit(0))
    return sorted((r["source"], r["message"]) for r in run_program(df, program, input_json="doc").collect())


def test_select(spark):
    assert _run(spark, Program(Select(".type", "==", "packet")), ['{"type":"packet"}', '{"type":"stats"}']) == [
        (0, '{"type":"packet"}')]


def test_project(spark):
    assert _run(spark, Program(Project(".payload.hash")), ['{"payload":{"hash":"abc"}}']) == [(0, '"abc"')]


def test_reshape(spark):
    assert _run(spark, Program(Reshape({"h": ".hash"})), ['{"hash":"x","extra":1}']) == [(0, '{"h":"x"}')]


def test_invalid_program_fails_when_built():
    with pytest.raises(ProgramError):
        Path.parse("not a path")
    with pytest.raises(ProgramError):
        Select(".a", "=~", 1)
    with pytest.raises(ProgramError):
        Program()


def test_missing_key_is_null_but_lookup_in_string_is_error(spark):
    docs = ['{"a":{"b":1}}', '{"a":null}', '{"x":1}', '{"a":"str"}', '{"a":[1]}']
    assert _run(spark, Program(Project(".a.b")), docs) == [(0, "1"), (1, "null"), (2, "null")]


def test_each_and_error_discards_all_outputs(spark):
    docs = ['{"xs":[1,2,3]}', '{"xs":[]}', '{"xs":null}', '{"xs":{"k":"v"}}', '{"xs":[{"a":1},"s"]}']
    got = _run(spark, Program(Each(".xs")), docs)
    assert got == [(0, "1"), (0, "2"), (0, "3"), (3, '"v"'), (4, '"s"'), (4, '{"a":1}')]
    # after fan-out a failing output (lookup in a string) drops the whole frame
    assert _run(spark, Program(Each(".xs"), Project(".a")), docs) == []


def test_select_jq_ordering(spark):
    docs = ['{"v":5}', '{"v":"5"}', '{"v":null}', '{"v":true}', '{"v":2.5}']
    assert [s for s, _ in _run(spark, Program(Select(".v", ">", 3)), docs)] == [0, 1]
    assert [s for s, _ in _run(spark, Program(Select(".v", "==", None)), docs)] == [2]


def test_program_errors_lists_skipped(spark):
    df = spark.createDataFrame([(0, '{"a":"s"}'), (1, '{"a":{}}')], "source int, doc string").withColumn("sequence", F.lit(0))
    assert run_program(df, Program(Project(".a.b")), input_json="doc").count() == 1
    assert [r["source"] for r in program_errors(df, Program(Project(".a.b")), input_json="doc").collect()] == [0]


def test_program_error_count_is_observed(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([(0, '{"a":"s"}'), (1, '{"a":{}}'), (2, '{"a":1}')], "source int, doc string").withColumn(
        "sequence", F.lit(0))
    obs = Observation("program_errors")
    out = run_program(df, Program(Project(".a.b")), input_json="doc", observation=obs)
    assert out.count() == 1
    assert obs.get["skipped_rows"] == 2


def test_errors_stay_with_their_frame_and_need_no_shuffle(spark):
    df = spark.createDataFrame([(0, 5, '{"xs":[{"a":1},{"a":2}]}'), (0, 5, '{"xs":[{"a":3},"s"]}')], "source int, sequence int, doc string")
    out = run_program(df, Program(Each(".xs"), Project(".a")), input_json="doc")
    assert sorted(r["message"] for r in out.collect()) == ["1", "2"]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_steps_after_each(spark):
    docs = ['{"xs":[{"a":[1,2],"b":"x"},{"a":[3],"b":"y"}]}']
    assert _run(spark, Program(Each(".xs"), Select(".b", "==", "y"), Each(".a")), docs) == [(0, "3")]
    assert _run(spark, Program(Each(".xs"), Each(".a")), docs) == [(0, "1"), (0, "2"), (0, "3")]
    assert _run(spark, Program(Each(".xs"), Reshape({"q": ".b"})), docs) == [(0, '{"q":"x"}'), (0, '{"q":"y"}')]


def test_integers_compare_exactly(spark):
    docs = ['{"v":9007199254740993}', '{"v":9007199254740992}', '{"v":9007199254740992.5}']
    assert [s for s, _ in _run(spark, Program(Select(".v", "==", 9007199254740992)), docs)] == [1, 2]
    assert [s for s, _ in _run(spark, Program(Select(".v", ">", 9007199254740992)), docs)] == [0]


def test_keys_with_any_characters(spark):
    docs = [json.dumps({"a'b": {"c`d": [10, {"z": 1, "a\"q": 2}]}, "?": 7, "*": 8}), '{"a\'b":5}', '{"a\'b":{"c`d":1},"a\'b":{"c`d":[0,{"y":0}]}}']
    assert _run(spark, Program(Project(""".["a'b"]["c`d"][1]""")), docs) == [(0, '{"z":1,"a\\"q":2}'), (2, '{"y":0}')]
    assert _run(spark, Program(Project(""".["a'b"]["c`d"][1]["a\\"q"]""")), docs[:1]) == [(0, "2")]
    assert _run(spark, Program(Reshape({"q": '.["?"]', "s'": '.["*"]'})), docs[:1]) == [(0, '{"q":7,"s\'":8}')]
    with pytest.raises(ProgramError):
        Path.parse('.["a]')


def jq(value, steps):
    """Outputs of a program on a parsed document, in order; None if it errs. A plain reading of the relay's rules."""
    def at(v, path):
        for key in path:
            if v is None:
                continue
            if isinstance(key, int) != isinstance(v, list) or not isinstance(v, (list, dict)):
                raise TypeError
            v = (v[key] if key < len(v) else None) if isinstance(key, int) else v.get(key)
        return v

    outs = [value]
    try:
        for kind, arg in steps:
            if kind == "path":
                outs = [at(v, arg) for v in outs]
            elif kind == "new":
                outs = [{k: at(v, p) for k, p in arg} for v in outs]
            else:
                inner = [at(v, arg) for v in outs]
                if any(not isinstance(v, (list, dict)) for v in inner):
                    return None
                outs = [x for v in inner for x in (v.values() if isinstance(v, dict) else v)]
    except TypeError:
        return None
    return [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in outs]


def as_program(steps):
    text = lambda p: "".join(f"[{x}]" if isinstance(x, int) else f"[{json.dumps(x)}]" for x in p)
    kinds = {"path": lambda p: Project("." + text(p)), "each": lambda p: Each("." + text(p)), "new": lambda fs: Reshape({k: "." + text(p) for k, p in fs})}
    return Program(*(kinds[k](a) for k, a in steps))


def random_value(r, depth=0):
    kind = r.random()
    if depth > 3 or kind < 0.4:
        return r.choice([None, True, False, 0, -7, 12345678901, 2.5, "", "x", "é\\ \"q'", "z`"])
    n = r.randrange(4)
    if kind < 0.6:
        return [random_value(r, depth + 1) for _ in range(n)]
    return {k: random_value(r, depth + 1) for k in r.sample(["z", "a", "m", "it's", "b`", "B"], n)}


@pytest.mark.parametrize("seed", [0, 1])
def test_order_of_keys_and_outputs_on_random_documents(spark, seed):
    r = random.Random(seed)
    docs = [{"z": random_value(r), "a": random_value(r), "it's": random_value(r)} for _ in range(150)]
    df = spark.createDataFrame([(i, 0, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "source int, sequence int, doc string")
    for steps in (
        [("path", ["z"])], [("path", ["it's", "z"])], [("each", ["a"])], [("each", []), ("each", [])], [("each", ["it's"]), ("path", ["m"])],
        [("new", [("q", ["z"]), ("a", ["it's"]), ("n", ["none"])])], [("new", [("y", ["z"]), ("b", ["a"])]), ("each", [])], [("each", []), ("new", [("k", ["z"]), ("c", ["b`"])])],
    ):
        rows = run_program(df, as_program(steps), keep=("source",), input_json="doc", position="at").collect()
        got = {}
        for row in sorted(rows, key=lambda row: (row["source"], row["at"])):
            assert row["at"] == len(got.setdefault(row["source"], []))
            got[row["source"]].append(row["message"])
        want = {i: o for i, d in enumerate(docs) if (o := jq(d, steps))}
        assert got == want, steps


def test_payload_objects_keep_the_order_of_the_payload(spark):
    from meshframes.sources.frames import decode_frames

    raw = [("s", 0, 1, 1, bytearray('{ "z" : {"b": 1, "a": [ {"y": 1, "x": 2} ]}, "a" : 3 }'.encode())), ("s", 1, 2, 1, bytearray(b"plain"))]
    frames = decode_frames(spark.createDataFrame(raw, "source string, sequence long, received_at_ms long, kind byte, payload binary"))
    out = lambda *steps: [r["message"] for r in run_program(frames, Program(*steps)).orderBy("sequence").collect()]
    assert out(Project(".payload")) == ['{"z":{"b":1,"a":[{"y":1,"x":2}]},"a":3}', '"plain"']
    assert out(Project(".payload.z")) == ['{"b":1,"a":[{"y":1,"x":2}]}']
    assert out(Reshape({"s": ".sequence", "p": ".payload.z.a"}), Each(".p")) == ['{"y":1,"x":2}']
    assert out(Each(".payload")) == ['{"b":1,"a":[{"y":1,"x":2}]}', "3"]


def test_a_payload_is_parsed_once_however_many_columns_read_it(spark):
    from meshframes.sources.frames import decode_frames

    raw = spark.range(6).selectExpr("concat('s', id) as source", "id as sequence", "id as received_at_ms", "cast(1 as byte) as kind",
                                    """cast(if(id % 2 = 0, concat('{"data":{"k":', id, ',"l":[1]}}'), 'plain') as binary) as payload""")
    for program, n in ((Program(Project(".payload.data.k")), 3), (Program(Select(".payload.data.k", ">=", 2)), 2), (Program(Each(".payload.data")), 6),
                       (Program(Reshape({"k": ".payload.data.k", "s": ".source"})), 3)):
        out = run_program(decode_frames(raw), program)
        assert out.count() == n
        # a filter on what decoding gives would be moved to the scan, with a copy of the decoding for each use
        assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
