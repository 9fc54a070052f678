"""Per-frame programs over the JSON projection.

The relay runs a user jq program per frame. Here a program is a short list of steps
built in Python and compiled to Column expressions: ``Select`` (F3), ``Path`` (P5),
``Reshape`` (P6) and ``Each`` (P7). A bad program fails when it is built. At run
time a step that looks up a key in a string, number or array (or indexes a non-
array) is an error: that frame is skipped whole (F4); a lookup on null or a missing
key gives null and the frame stays.

A value is carried twice: as VARIANT, for types and comparisons, and as the JSON text it is rendered from, since VARIANT
sorts an object's fields by name. Text of nested objects and arrays is cut out of the text one level up, so keys
and an object's values come in the order of the document; scalars are rendered from the VARIANT.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from meshframes.sources.output import json_line


class ProgramError(ValueError):
    pass


_TOKEN = re.compile(r'\.([A-Za-z_][A-Za-z0-9_]*)|\.?\[("(?:[^"\\]|\\.)*")\]|\.?\[(\d+)\]')
#: Keys that Spark's JSON and variant paths can name; others are looked up in maps.
_PLAIN_KEY = re.compile(r"[^'`?*\\]+")


@dataclass(frozen=True)
class Path:
    """A jq-style path: ``.a.b``, ``.["a b"]``, ``.a[0]``; ``.`` is the input."""

    steps: tuple

    @staticmethod
    def parse(text: str) -> "Path":
        t = text.strip()
        if t == ".":
            return Path(())
        if not t.startswith("."):
            raise ProgramError(f"invalid path: {text!r}")
        steps, pos = [], 0
        while pos < len(t):
            m = _TOKEN.match(t, pos)
            if not m:
                raise ProgramError(f"invalid path: {text!r}")
            key, qkey, idx = m.groups()
            try:
                steps.append(int(idx) if idx is not None else (key if key is not None else json.loads(qkey)))
            except json.JSONDecodeError as e:
                raise ProgramError(f"invalid path: {text!r}") from e
            pos = m.end()
        return Path(tuple(steps))


def _json_path(steps) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def _plain(step) -> bool:
    return isinstance(step, int) or bool(_PLAIN_KEY.fullmatch(step))


def _path(p) -> Path:
    return p if isinstance(p, Path) else Path.parse(p)


@dataclass(frozen=True)
class Select:
    """``select(<path> <op> <literal>)``; op one of == != < <= > >=."""

    path: Path
    op: str
    value: object

    def __init__(self, path, op: str, value):
        if op not in ("==", "!=", "<", "<=", ">", ">="):
            raise ProgramError(f"unsupported operator {op!r}")
        if value is not None and not isinstance(value, (str, int, float, bool)):
            raise ProgramError("select compares with a JSON scalar")
        object.__setattr__(self, "path", _path(path))
        object.__setattr__(self, "op", op)
        object.__setattr__(self, "value", value)


@dataclass(frozen=True)
class Project:
    """``<path>``: the value at a path becomes the output."""

    path: Path

    def __init__(self, path):
        object.__setattr__(self, "path", _path(path))


@dataclass(frozen=True)
class Reshape:
    """``{name: <path>, ...}``: a new object from chosen paths, in the given order."""

    fields: tuple

    def __init__(self, fields: dict):
        if not fields:
            raise ProgramError("reshape needs at least one field")
        object.__setattr__(self, "fields", tuple((str(k), _path(v)) for k, v in fields.items()))


@dataclass(frozen=True)
class Each:
    """``<path>[]``: one output per element (array) or value (object)."""

    path: Path

    def __init__(self, path):
        object.__setattr__(self, "path", _path(path))


@dataclass(frozen=True)
class Program:
    steps: tuple

    def __init__(self, *steps):
        if not steps:
            raise ProgramError("empty program")
        for s in steps:
            if not isinstance(s, (Select, Project, Reshape, Each)):
                raise ProgramError(f"not a program step: {s!r}")
        object.__setattr__(self, "steps", tuple(steps))


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _has_keys(v: Column, key: str) -> Column:
    """True if ``v`` is an object (its other fields are not read)."""
    return F.try_variant_get(v, "$", f"struct<`{key}`:variant>").isNotNull() if _plain(key) else _object(v).isNotNull()


def _lookup(v: Column, path: Path) -> tuple[Column, Column]:
    """(value, error) of ``path`` on variant ``v``: error when a step meets a type it
    cannot look into; a null or missing value passes null on."""
    err, base, run = F.lit(False), v, []
    for step in path.steps:
        pv = F.try_variant_get(base, _json_path(run), "variant") if run else base
        nullish = pv.isNull() | F.is_variant_null(pv)
        if isinstance(step, int):
            fits = F.coalesce(F.schema_of_variant(pv).startswith("ARRAY"), F.lit(False))
        else:
            fits = _has_keys(pv, step)
        err = err | ~(nullish | fits)
        if _plain(step):
            run.append(step)
        else:
            base, run = F.try_element_at(_object(pv), F.lit(step)), []
    return F.try_variant_get(base, _json_path(run), "variant") if run else base, err


def _entries(text: Column) -> Column:
    """(key, value) pairs of an object's text, in its order; values that are objects or arrays as text."""
    return F.map_entries(F.from_json(text, "map<string,string>"))


def _items(text: Column) -> Column:
    """Elements of an array's text, those that are objects or arrays as text."""
    return F.from_json(text, "array<string>")


def _last_of(entries: Column, key: Column) -> Column:
    """Of repeated keys the last one counts."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def _text_at(text: Column, path: Path) -> Column:
    """Text of the object or array at ``path`` in a document's text (whatever for other types)."""
    run: list = []
    for step in path.steps:
        if _plain(step):
            run.append(step)
        else:
            text, run = _last_of(_entries(F.get_json_object(text, _json_path(run))), F.lit(step)), []
    return F.get_json_object(text, _json_path(run))


def _rendered(v: Column, text: Column) -> Column:
    """JSON text of value ``v``; ``text``: its text, of use if it is an object or array."""
    kind = F.schema_of_variant(v)
    nested = F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))
    return F.coalesce(F.when(nested, text).otherwise(F.to_json(v)), F.lit("null"))


_NUMERIC = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")


def _rank(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (t == "VOID"), F.lit(0))
        .when(t == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit(2)).otherwise(F.lit(1)))
        .when(t.isin(*_NUMERIC) | t.startswith("DECIMAL"), F.lit(3))
        .when(t == "STRING", F.lit(4))
        .when(t.startswith("ARRAY"), F.lit(5))
        .otherwise(F.lit(6))
    )


def _compare(v: Column, op: str, lit) -> Column:
    """jq ordering: null < false < true < numbers < strings < arrays < objects."""
    if lit is None:
        lrank = 0
    elif isinstance(lit, bool):
        lrank = 2 if lit else 1
    elif isinstance(lit, (int, float)):
        lrank = 3
    else:
        lrank = 4
    r = _rank(v)
    if lrank == 3:
        def compared(kind: str, x) -> Column:
            a, b = F.try_variant_get(v, "$", kind), F.lit(x).cast(kind)
            return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

        cmp_same = compared("double", float(lit))
        if isinstance(lit, int) and abs(lit) < 10**38:  # integers compare exactly
            t = F.schema_of_variant(v)
            whole = t.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | t.rlike(r"^DECIMAL\(\d+,\s*0\)$")
            cmp_same = F.when(whole, compared("decimal(38,0)", Decimal(lit))).otherwise(cmp_same)
    elif lrank == 4:
        same = F.try_variant_get(v, "$", "string")
        cmp_same = {"==": same == F.lit(lit), "!=": same != F.lit(lit), "<": same < F.lit(lit),
                    "<=": same <= F.lit(lit), ">": same > F.lit(lit), ">=": same >= F.lit(lit)}[op]
    else:
        cmp_same = {"==": F.lit(True), "!=": F.lit(False), "<": F.lit(False), "<=": F.lit(True),
                    ">": F.lit(False), ">=": F.lit(True)}[op]
    cmp_other = {"==": F.lit(False), "!=": F.lit(True), "<": r < lrank, "<=": r < lrank,
                 ">": r > lrank, ">=": r > lrank}[op]
    return F.coalesce(F.when(r == lrank, cmp_same).otherwise(cmp_other), F.lit(False))


def projection_variant(encoding="encoding", payload_text="payload_text") -> Column:
    """The projection object as VARIANT (the identity program's value); needs the
    parsed payload in ``_pdoc``."""
    enc = F.col(encoding)
    payload = F.when(enc == "json", F.col("_pdoc")).otherwise(
        F.col(payload_text).cast("variant")
    )
    return F.to_variant_object(
        F.struct(
            F.col("source").alias("source"),
            F.col("sequence").alias("sequence"),
            F.col("received_at_ms").alias("timestamp_ms"),
            F.col("kind").cast("int").alias("kind"),
            enc.alias("encoding"),
            payload.alias("payload"),
        )
    )


_SCALARS = {"source": "source", "sequence": "sequence", "timestamp_ms": "received_at_ms", "kind": "kind",
            "encoding": "encoding"}


def _lookup_projection(path: Path) -> tuple[Column, Column, Column]:
    """(value, its text, error) of ``path`` on the projection object, read from the frame's
    columns: only ``.payload`` goes into the parsed document, so large text payloads
    are never copied into a VARIANT unless they are the output."""
    null = F.lit(None).cast("variant")
    if not path.steps:
        return projection_variant(), json_line(), F.lit(False)
    head, rest = path.steps[0], Path(path.steps[1:])
    if isinstance(head, int):  # indexing an object
        return null, F.lit("null"), F.lit(True)
    if head == "payload":
        is_json = F.col("encoding") == "json"
        val, err = _lookup(F.col("_pdoc"), rest)
        text = _rendered(val, _text_at(F.col("payload_text"), rest))
        if not rest.steps:
            whole = F.col("payload_text").cast("variant")
            return F.when(is_json, val).otherwise(whole), F.when(is_json, text).otherwise(F.coalesce(F.to_json(whole), F.lit("null"))), F.lit(False)
        # any lookup into a string payload (utf8 / base64) is an error
        return F.when(is_json, val), text, F.when(is_json, err).otherwise(F.lit(True))
    if head in _SCALARS:
        col = F.col(_SCALARS[head])
        if rest.steps:
            return null, F.lit("null"), F.lit(True)
        val = (col.cast("int") if head == "kind" else col).cast("variant")
        return val, F.coalesce(F.to_json(val), F.lit("null")), F.lit(False)
    return null, F.lit("null"), F.lit(False)  # missing key: null all the way down


def _lookup_both(v: Column, text: Column, path: Path) -> tuple[Column, Column, Column]:
    val, err = _lookup(v, path)
    return val, _rendered(val, _text_at(text, path)), err


def _rows(d: DataFrame, holds: Column) -> DataFrame:
    """The rows for which ``holds`` is true, as a generator of one row or none.

    A filter would be moved below the columns that it reads, down to the scan, with a copy of
    their expressions for each use: the payload would be decoded and parsed dozens of times."""
    return d.select(*[f"`{c}`" for c in d.columns], F.explode(F.when(holds, F.array(F.lit(True)))).alias("_pheld")).drop("_pheld")


def _run(frames: DataFrame, program: Program, keep, input_json: str | None = None) -> tuple[DataFrame, Column, Column]:
    """Rows with ``_perr``, the text of each output and its position among those of its frame."""
    if input_json is None:
        # the projection stays virtual until a step produces a new value
        doc = F.col("payload_v") if "payload_v" in frames.columns else F.try_parse_json(F.col("payload_text"))
        d = frames.withColumn("_pdoc", F.when(F.col("encoding") == "json", doc))
        text: Column = json_line()  # identity so far: the projection text
        on_projection = True
    else:
        d = frames.withColumn("_pv", F.try_parse_json(F.col(input_json))).withColumn("_ptxt", F.col(input_json))
        text = F.col(input_json)
        on_projection = False
    d = d.withColumn("_perr", F.lit(False))

    def lookup(p: Path):
        return _lookup_projection(p) if on_projection else _lookup_both(F.col("_pv"), F.col("_ptxt"), p)

    def kept_apart(**columns: Column) -> None:
        """Columns of their own, read more than once below."""
        nonlocal d
        d = d.withColumns(columns)

    outs = None  # after the first Each: the frame's outputs so far, as array<struct<err, v, txt>>
    for step in program.steps:
        if outs is not None:
            outs = _each_output(outs, step)
        elif isinstance(step, Select):
            val, _, err = lookup(step.path)
            kept_apart(_perr=F.col("_perr") | err, _pval=val)
            d = _rows(d, F.col("_perr") | _compare(F.col("_pval"), step.op, step.value))
        elif isinstance(step, (Project, Reshape)):
            val, txt, err = lookup(step.path) if isinstance(step, Project) else _reshaped(step, lookup)
            d = d.withColumns({"_perr": F.col("_perr") | err, "_pv": val, "_ptxt": txt})
            text, on_projection = F.col("_ptxt"), False
        elif isinstance(step, Each):
            val, txt, err = lookup(step.path)
            kept_apart(_perr=F.col("_perr") | err, _pval=val, _ptext=txt)
            kept_apart(_pelems=_elements(F.col("_pval"), F.col("_ptext")))
            kept_apart(_perr=F.col("_perr") | F.col("_pelems").isNull())
            none = F.array().cast("array<struct<err:boolean,v:variant,txt:string>>")
            outs = F.coalesce(F.col("_pelems"), none)
    if outs is None:
        return d, text, F.lit(0)
    # one failing output discards every output of that frame; an erring frame keeps one row that carries the error
    d = d.withColumn("_pouts", outs)
    d = d.withColumn("_perr", F.col("_perr") | F.exists("_pouts", lambda o: o["err"]))
    one = F.array(_output(F.lit(True), F.lit(None).cast("variant"), F.lit(None).cast("string")))
    passed = [F.col(f"`{c}`") for c in d.columns if c != "_pouts"]
    d = d.select(*passed, F.posexplode(F.when(F.col("_perr"), one).otherwise(F.col("_pouts"))).alias("_ppos", "_pout"))
    return d, F.col("_pout.txt"), F.col("_ppos")


def _output(err: Column, v: Column, txt: Column) -> Column:
    return F.struct(err.alias("err"), v.alias("v"), txt.alias("txt"))


def _elements(val: Column, txt: Column) -> Column:
    """Outputs for the elements of an array or the values of an object, in the document's order; null for anything else."""
    arr, obj = F.try_variant_get(val, "$", "array<variant>"), _object(val)
    of_array = F.zip_with(arr, _items(txt), lambda v, t: _output(F.lit(False), v, _rendered(v, F.get_json_object(t, "$"))))

    def of_object(x: Column) -> Column:
        def value(key: Column) -> Column:
            v = F.try_element_at(x["obj"], key)
            return _output(F.lit(False), v, _rendered(v, F.get_json_object(_last_of(x["entries"], key), "$")))

        return F.transform(F.array_distinct(F.transform(x["entries"], lambda e: e["key"])), value)

    # both are read for each key, so they are bound once
    bound = F.struct(obj.alias("obj"), _entries(txt).alias("entries"))
    return F.when(arr.isNotNull(), of_array).when(obj.isNotNull(), F.get(F.transform(F.array(bound), of_object), F.lit(0)))


def _reshaped(step: Reshape, lookup) -> tuple[Column, Column, Column]:
    parts, texts, errs = [], [], F.lit(False)
    for name, p in step.fields:
        val, txt, err = lookup(p)
        parts.append(val.alias(name))
        texts.append(F.concat(F.lit(("," if texts else "{") + json.dumps(name, ensure_ascii=False) + ":"), txt))
        errs = errs | err
    return F.to_variant_object(F.struct(*parts)), F.concat(*texts, F.lit("}")), errs


def _each_output(outs: Column, step) -> Column:
    """A step applied to each output of the frame; an output that has erred stays as it is."""
    if isinstance(step, Select):
        def keep(o: Column) -> Column:
            val, err = _lookup(o["v"], step.path)
            return o["err"] | err | _compare(val, step.op, step.value)

        def mark(o: Column) -> Column:
            return _output(o["err"] | _lookup(o["v"], step.path)[1], o["v"], o["txt"])

        return F.transform(F.filter(outs, keep), mark)

    def looked_up(o: Column):
        return lambda p: _lookup_both(o["v"], o["txt"], p)

    if isinstance(step, (Project, Reshape)):
        def changed(o: Column) -> Column:
            val, txt, err = looked_up(o)(step.path) if isinstance(step, Project) else _reshaped(step, looked_up(o))
            return _output(o["err"] | err, val, txt)

        return F.transform(outs, changed)

    def fan(o: Column) -> Column:
        val, txt, err = looked_up(o)(step.path)
        failed = F.array(_output(F.lit(True), F.lit(None).cast("variant"), F.lit(None).cast("string")))
        return F.coalesce(F.when(~(o["err"] | err), _elements(val, txt)), failed)

    return F.flatten(F.transform(outs, fan))


def run_program(frames: DataFrame, program: Program, keep=("source", "sequence"), input_json: str | None = None,
                observation=None, position: str | None = None) -> DataFrame:
    """Outputs of ``program`` per frame: ``keep`` columns + ``message`` (JSON text), and with ``position`` a column of that
    name: the output's place among those of its frame, from 0, in the order the relay sends them.

    The input is the frame's projection, or the JSON text column ``input_json``.
    Zero outputs drop the frame; a runtime error skips the frame and all of its
    outputs (F4). Steps compile to Column expressions (no Python per row).
    ``observation`` (a ``pyspark.sql.Observation`` or a metric name): rows skipped by
    a program error are counted as ``skipped_rows`` in the same pass.
    """
    d, msg, place = _run(frames, program, list(keep), input_json)
    if observation is not None:
        d = d.observe(observation, F.count_if(F.col("_perr")).alias("skipped_rows"))
    return _rows(d, ~F.col("_perr")).select(*keep, *([place.alias(position)] if position else []), msg.alias("message"))


def program_errors(frames: DataFrame, program: Program, keep=("source", "sequence"), input_json: str | None = None) -> DataFrame:
    """F4 bookkeeping: the frames a program run skipped because of an error."""
    d, _, _ = _run(frames, program, list(keep), input_json)
    return _rows(d, F.col("_perr")).select(*keep).distinct()
