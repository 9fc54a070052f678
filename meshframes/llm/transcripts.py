"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A conversation is a sequence of messages (conv_id, turn, text), a message a sequence of lines. Hidden states are the roles.
Each line shows a speaker marker or none (``User:``, ``**Assistant**:``, ``### System``), whether it begins a message, its length and
its last character. The chance of going from one role to another differs between lines that begin a message and others. :func:`fit` counts emissions and transitions on
messages with a known role outside the held-out conversations, all of them, in Spark (add-one smoothing, and a prior
for markers); only the counts reach the driver. The column ``role`` is never an input of :func:`parse`.

:func:`parse` finds the best path of each whole conversation by Viterbi. A message acts on the roles as a small
max-plus matrix, and matrices of consecutive messages multiply; so a conversation of any length is cut into blocks of
``BLOCK`` turns, blocks are reduced to one matrix each in parallel, a conversation's matrices (one for each block) give the
role in which each block begins and ends, and blocks are then decoded independently.
The rendered turns join runs of lines with one role in a message, without the markers, as ``<|role|>\\ntext<|end|>``.

Defined results: a null or blank text is one empty line; rows without conv_id form one conversation; null turns come first; rows of the
same turn follow each other by text; ties go to the role that is first in alphabetical order; without known roles
every line gets the role of its marker or else ``user``; ``part``, ``role_pred``, ``content`` and ``rendered`` replace columns of those names, others pass.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BLOCK = 512
#: Speaker names in markers, by role.
SPEAKERS = {
    "assistant": "ai answer a agent assistant bot chatbot gpt model response".split(),
    "system": "context instruction instructions prompt system".split(),
    "user": "customer human me question q user you".split(),
}
ROLE_OF = {name: role for role, names in SPEAKERS.items() for name in names}
MARKER = re.compile(r"^\s*(?:#{1,6}\s*|>\s*|[-*]\s+)?(?:\*\*|__|\[|<\|?)?\s*(" + "|".join(sorted(ROLE_OF, key=len, reverse=True)) + r")\s*(?:(?:\*\*|__|\]|\|?>)\s*:?|(?:\*\*|__)?\s*:(?:\*\*|__)?)\s*", re.IGNORECASE)
HEADING = re.compile(r"^\s*#{1,6}\s*(" + "|".join(sorted(ROLE_OF, key=len, reverse=True)) + r")\s*:?\s*$", re.IGNORECASE)
#: How often a marker is taken to tell the truth before anything is counted.
MARKER_PRIOR = 1000.0
#: How often the next line of a message is taken to have the same speaker before anything is counted.
STAY_PRIOR = 50.0
ENDS = "?!.,:"


def read_line(line: str) -> tuple[str, str]:
    """(role that its marker names or "", the line without the marker)."""
    m = HEADING.match(line) or MARKER.match(line)
    return (ROLE_OF[m[1].lower()], line[m.end() :]) if m else ("", line)


def features(line: str, begins: bool) -> tuple[str, str, str]:
    marker, rest = read_line(line)
    rest = rest.rstrip()
    last = rest[-1] if rest and rest[-1] in ENDS else "-"
    return "m" + marker, f"{'b' if begins else 'i'}{min(12, len(rest.split()).bit_length())}", ("b" if begins else "i") + last


def lines_of(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x.strip()] or [""]


@dataclass
class Model:
    """Logarithms: move[begins][from][to], where the last ``from`` is the time before the first line; emit[feature][role]
    (a feature never seen counts for nothing)."""

    roles: list[str]
    move: np.ndarray
    emit: dict[str, np.ndarray]

    def steps(self, lines: list[str]) -> list[np.ndarray]:
        """[from or before][to] for each line of a message; a marker may change the speaker as a new message may."""
        zero = np.zeros(len(self.roles))
        out = []
        for i, x in enumerate(lines):
            seen = features(x, i == 0)
            out.append(self.move[int(i == 0 or seen[0] != "m")] + sum((self.emit.get(f, zero) for f in seen), zero))
        return out

    def matrix(self, text: str | None) -> np.ndarray:
        """[from][to]: the best score of a message, given the role before it."""
        return functools.reduce(max_plus, self.steps(lines_of(text)))


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First ``a``, then ``b``; both [from or before][to]."""
    return (a[:, :, None] + b[None, :-1, :]).max(axis=1)


def viterbi(enter: np.ndarray, moves: list[np.ndarray], leave: np.ndarray) -> list[int]:
    """States of the best path: ``enter`` scores the state before the first step, ``moves[i][from][to]`` each step, ``leave`` the last state."""
    v, back = enter, []
    for m in moves:
        s = v[:, None] + m
        back.append(s.argmax(axis=0))
        v = np.append(s.max(axis=0), -np.inf)
    at = int((v + leave).argmax())
    path = []
    for b in reversed(back):
        path.append(at)
        at = int(b[at])
    return path[::-1]


def from_counts(counts: dict[tuple[str, str, str], int]) -> Model:
    """counts: ("role", role, "") / ("start", role, "") / ("move1" or "move0", from, to) / (feature, role, "")."""
    roles = sorted({b for (a, b, _) in counts if a == "role"} | set(SPEAKERS))
    at = {r: i for i, r in enumerate(roles)}
    n = len(roles)
    start, move = np.ones(n), np.ones((2, n, n))
    move[0] += np.eye(n) * STAY_PRIOR  # lines of a message seldom change the speaker
    kinds: dict[str, set[str]] = {}
    seen: dict[str, np.ndarray] = {}
    for m in ["m"] + ["m" + r for r in SPEAKERS]:
        seen[m] = np.ones(n)
        if m != "m":
            seen[m][at[m[1:]]] += MARKER_PRIOR
    for (a, b, c), k in counts.items():
        if a == "start":
            start[at[b]] += k
        elif a in ("move0", "move1"):
            move[int(a[4]), at[b], at[c]] += k
        elif a != "role":
            seen.setdefault(a, np.ones(n))[at[b]] += k
    for f in seen:
        kinds.setdefault("m" if f[0] == "m" else f[0] + ("w" if f[1:].isdigit() else "e"), set()).add(f)
    emit = {}
    for group in kinds.values():
        total = sum(seen[f] for f in group)
        emit.update({f: np.log(seen[f] / total) for f in group})
    if not any(a == "role" for a, _, _ in counts):
        start[at["user"]] += 1
        move[1, :, at["user"]] += 1
    first = np.log(start / start.sum())
    move = np.log(move / move.sum(axis=2, keepdims=True))
    return Model(roles, np.stack([np.vstack([m, first]) for m in move]), emit)


def held_out(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.crc32(F.col(conv_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _ordered(df: DataFrame, partitions: int) -> DataFrame:
    """Messages of a block in one partition, in order."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(0)).cast("long")
    return df.withColumn("__llm_block", block).repartition(partitions, "conv_id", "__llm_block").sortWithinPartitions("conv_id", "__llm_block", "turn", "text")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[pa.RecordBatch, int]]]]:
    """Consecutive rows of one (conv_id, _block)."""
    key, rows = None, []
    for b in batches:
        for i, k in enumerate(zip(b.column("conv_id").to_pylist(), b.column("__llm_block").to_pylist())):
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append((b, i))
    if rows:
        yield key, rows


def fit(messages: DataFrame) -> Model:
    """Learn from messages (conv_id, turn, role, text) with a role, of conversations that are not held out."""
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = messages.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull() & F.col("role").isNotNull() & ~held_out())

    def count(batches):
        c: Counter = Counter()
        for (_, block), rows in _groups(batches):
            before = None
            for b, i in rows:
                role = b.column("role")[i].as_py()
                c["role", role, ""] += 1
                if before is not None:
                    c["move1", before, role] += 1
                elif block == 0:
                    c["start", role, ""] += 1
                lines = lines_of(b.column("text")[i].as_py())
                for j, x in enumerate(lines):
                    seen = features(x, j == 0)
                    c["move0", role, role] += j > 0 and seen[0] == "m"
                    for f in seen:
                        c[f, role, ""] += 1
                before = role
        yield pa.RecordBatch.from_pydict({"a": [k[0] for k in c], "b": [k[1] for k in c], "c": [k[2] for k in c], "n": list(c.values())})

    counted = _ordered(known, n).mapInArrow(count, "a string, b string, c string, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    return from_counts({(r.a, r.b, r.c): r.n for r in counted.collect()})  # roles x (features + roles) rows


def parse(messages: DataFrame, model: Model) -> DataFrame:
    """A row for each turn: columns of ``messages`` with ``part`` (from 0 in its message), ``role_pred``, ``content`` and ``rendered``."""
    spark = messages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    new = ["part", "role_pred", "content", "rendered"]
    kept = [c for c in messages.columns if c not in new]
    size = len(model.roles)
    ordered = _ordered(messages.select(kept), n)

    def reduce(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.float64())))], names=["conv_id", "block", "m"])

        out: list[tuple] = []
        for (conv, block), rows in _groups(batches):
            m = None
            for b, i in rows:
                x = model.matrix(b.column("text")[i].as_py())
                m = x if m is None else max_plus(m, x)
            out.append((conv, block, m.ravel().tolist()))
            if len(out) == 5_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def ends(batches):
        def chains():
            key, blocks, ms = None, [], []
            for b in batches:
                for conv, block, m in zip(*(b.column(c).to_pylist() for c in ("conv_id", "block", "m"))):
                    if blocks and conv != key:
                        yield key, blocks, ms
                        blocks, ms = [], []
                    key = conv
                    blocks.append(block)
                    ms.append(np.array(m).reshape(size + 1, size))
            if blocks:
                yield key, blocks, ms

        for conv, blocks, ms in chains():
            path = viterbi(only(size + 1, size), ms, np.zeros(size + 1))
            yield pa.RecordBatch.from_pydict(
                {"conv_id": pa.array([conv] * len(blocks), pa.int64()), "block": pa.array(blocks, pa.int64()), "enter": pa.array([-1, *path[:-1]], pa.int32()), "leave": pa.array(path, pa.int32())})

    narrow = ordered.select("conv_id", "__llm_block", "turn", "text")
    one = narrow.mapInArrow(reduce, "conv_id long, block long, m array<double>")
    one = one.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    # only conversations of several blocks need their ends
    long_ = one.where("count > 1").select("conv_id", "block", "m").repartition(n, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(ends, "conv_id long, block long, enter int, leave int")
    fixed = long_.select(F.col("conv_id").alias("__llm_c"), F.col("block").alias("__llm_cb"), F.col("enter").alias("__llm_enter"), F.col("leave").alias("__llm_leave"))
    rows = messages.select(kept).withColumn("__llm_block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(0)).cast("long"))
    rows = rows.join(fixed, F.col("conv_id").eqNullSafe(F.col("__llm_c")) & (F.col("__llm_block") == F.col("__llm_cb")), "left")
    rows = rows.drop("__llm_c", "__llm_cb")
    rows = rows.repartition(n, "conv_id", "__llm_block").sortWithinPartitions("conv_id", "__llm_block", "turn", "text")
    schema = T.StructType([*(messages.schema[c] for c in kept), T.StructField("part", T.IntegerType()), T.StructField("role_pred", T.StringType()), T.StructField("content", T.StringType()), T.StructField("rendered", T.StringType())])

    def decode(batches):
        take: list[tuple[pa.RecordBatch, int, int, str, str]] = []

        def batch():
            rows = pa.Table.from_batches([x.slice(j, 1).select(kept) for x, j, *_ in take])
            columns = [rows.column(c).combine_chunks() for c in kept]
            added = [pa.array([t[2] for t in take], pa.int32()), *(pa.array(c, pa.string()) for c in zip(*((t[3], t[4], f"<|{t[3]}|>\n{t[4]}<|end|>") for t in take)))]
            return pa.RecordBatch.from_arrays([*columns, *added], names=[*kept, *new])

        for _, group in _groups(batches):
            b, i = group[0]
            enter, leave = b.column("__llm_enter")[i].as_py(), b.column("__llm_leave")[i].as_py()
            texts = [lines_of(x.column("text")[j].as_py()) for x, j in group]
            moves = [m for lines in texts for m in model.steps(lines)]
            v = only(size + 1, size if enter is None or enter < 0 else enter)
            path = iter(viterbi(v, moves, np.zeros(size + 1) if leave is None else only(size + 1, leave)))
            for (x, j), lines in zip(group, texts):
                parts: list[tuple[str, list[str]]] = []
                for line in lines:
                    role = model.roles[next(path)]
                    marker, rest = read_line(line)
                    if not parts or parts[-1][0] != role:
                        parts.append((role, []))
                    parts[-1][1].append(rest if marker else line)
                take += [(x, j, k, role, "\n".join(some).strip()) for k, (role, some) in enumerate(parts)]
            if len(take) >= 2_000:
                yield batch()
                take.clear()
        if take:
            yield batch()

    return rows.mapInArrow(decode, schema)


def only(size: int, state: int) -> np.ndarray:
    out = np.full(size, -np.inf)
    out[state] = 0.0
    return out
