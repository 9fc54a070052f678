"""Arrival-driven rotation (D1): which generation every arrival falls into.

The relay rotates on the first arrival at least W after the last rotation, so each rotation depends on the one before. Only one
number is carried from one stretch of time to the next: the threshold from which the next arrival rotates (last
rotation + W). A stretch (tile) at least W long is therefore a step function threshold -> (threshold after it, rotations in it),
and a threshold in effect at a tile's start lies within W of it, so the function has at most as many classes as
there are distinct arrivals in the tile's first W; neighbouring classes with one result are merged.

Tiles of ``span`` windows are read off the arrivals; ``span`` tiles make a tile of the next level by composing their functions, until
one tile covers all time (up). Then every tile tells its children the threshold and count they start with (down), and tiles
of the first level number their arrivals. So there are ``2 * log(time / W, span)`` passes, each a shuffle by (key, tile); rows fall by
about ``span`` a level, a subscription with most of the arrivals is spread over its tiles, and a tile's arrivals, with
``span`` chosen for them, are some :data:`TILE_ARRIVALS` distinct milliseconds at most (or two windows).

Following a chain has no built-in expression, so a tile is one numpy step inside its task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from meshframes.session import materialize

#: Windows (or tiles) in a tile: at most, and so many that it holds about this many distinct arrivals.
MOST_SPAN = 32
TILE_ARRIVALS = 4_000_000


def _merged(hi: np.ndarray, out: np.ndarray, cnt: np.ndarray) -> tuple[np.ndarray, ...]:
    last = np.append((out[1:] != out[:-1]) | (cnt[1:] != cnt[:-1]), True)
    return hi[last], out[last], cnt[last]


def tile_function(x: np.ndarray, start: int, size: int, window: int) -> tuple[np.ndarray, ...]:
    """Classes (hi, out, cnt) of a tile with arrivals ``x`` (ascending): a threshold in (previous hi, hi] leaves as ``out`` after ``cnt`` rotations."""
    n, end = len(x), start + size
    jump = np.searchsorted(x, x + window)
    last, cnt = x.copy(), np.ones(n, np.int64)
    while (more := jump < n).any():  # pointer doubling along the chain of rotations
        at = jump[more]
        last[more], cnt[more], jump[more] = last[at], cnt[more] + cnt[at], jump[at]
    out = np.maximum(last + window, end)
    k = int(np.searchsorted(x, start + window, "right"))
    top = start + window
    if k and x[k - 1] == top:
        return _merged(x[:k], out[:k], cnt[:k])
    rest = (out[k], cnt[k]) if k < n else (end, 0)
    return _merged(np.append(x[:k], top), np.append(out[:k], rest[0]), np.append(cnt[:k], rest[1]))


def composed(children: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], start: int, end: int, window: int) -> tuple[np.ndarray, ...]:
    """Classes of the tile made of ``children`` (start, hi, out, cnt) in time order."""
    first, hi, out, cnt = children[0]
    if first > start:  # nothing arrived in the first windows: whatever the threshold was, it has passed
        hi, out, cnt = np.array([start + window]), out[:1], cnt[:1]
    for at, h, o, c in children[1:]:
        j = np.searchsorted(h, np.maximum(out, at))
        out, cnt = o[j], cnt + c[j]
    return _merged(hi, np.maximum(out, end), cnt)


def _children(table: pa.Table, size: int):
    """(start, hi, out, cnt) of each child of a tile, in time order."""
    cols = [table.column(c).to_numpy() for c in ("child", "hi", "out", "cnt")]
    order = np.lexsort((cols[1], cols[0]))
    child, hi, out, cnt = (c[order] for c in cols)
    cuts = np.flatnonzero(child[1:] != child[:-1]) + 1
    return [(int(c[0]) * size, h, o, n) for c, h, o, n in zip(*(np.split(a, cuts) for a in (child, hi, out, cnt)))]


def _start(table: pa.Table) -> tuple[int, int, pa.Table]:
    """Threshold and count with which the tile begins, and its other rows."""
    own = table.filter(pc.is_valid(table.column("v")))
    return own.column("v")[0].as_py(), own.column("n")[0].as_py(), table.filter(pc.is_null(table.column("v")))


def rotation_generations(arrivals: DataFrame, keys: Sequence[str], window_ms: int, origin: str = "_origin") -> DataFrame:
    """(keys, received_at_ms, _gen): the number of rotations up to every distinct arrival time, those before the origin left out.

    ``arrivals``: distinct (keys, received_at_ms, origin); the subscription's start counts as its first rotation."""
    keys, w = list(keys), int(window_ms)
    own = arrivals.select(*keys, (F.col("received_at_ms") - F.col(origin)).alias("x"), F.col(origin).cast("long").alias("o")).where("x >= 0")
    own = materialize(own, "rotation-arrivals")
    block = F.floor(F.col("x") / w).cast("long")
    seen = own.groupBy(*keys, block.alias("b")).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("most"), F.max("b").alias("last")).first()
    if seen["most"] is None:
        return own.select(*keys, F.col("x").alias("received_at_ms"), F.lit(0).cast("long").alias("_gen"))
    span = int(min(max(TILE_ARRIVALS // seen["most"], 2), MOST_SPAN))
    levels = 1
    while span**levels <= seen["last"]:
        levels += 1
    sizes = [w * span ** (i + 1) for i in range(levels)]
    kept = [arrivals.schema[k] for k in keys]

    def schema(*fields: str) -> T.StructType:
        return T.StructType([*kept, *(T.StructField(f, T.LongType()) for f in fields)])

    def table(key: tuple, **cols) -> pa.Table:
        n = len(next(iter(cols.values())))
        fixed = {k: pa.array([v.as_py()] * n, v.type) for k, v in zip(keys, key)}
        return pa.table({**fixed, **{c: pa.array(np.broadcast_to(v, n), pa.int64()) for c, v in cols.items()}})

    def grouped(df: DataFrame, by: Column, fn, *fields: str) -> DataFrame:
        return df.withColumn("tile", by).groupBy(*keys, "tile").applyInArrow(fn, schema(*fields))

    def read_off(key: tuple, t: pa.Table) -> pa.Table:
        tile = key[-1].as_py()
        hi, out, cnt = tile_function(np.sort(t.column("x").to_numpy()), tile * sizes[0], sizes[0], w)
        return table(key, child=np.full(len(hi), tile), hi=hi, out=out, cnt=cnt)

    def compose(i: int):
        def fn(key: tuple, t: pa.Table) -> pa.Table:
            tile = key[-1].as_py()
            hi, out, cnt = composed(_children(t, sizes[i - 1]), tile * sizes[i], (tile + 1) * sizes[i], w)
            return table(key, child=np.full(len(hi), tile), hi=hi, out=out, cnt=cnt)

        return fn

    def hand_down(i: int):
        def fn(key: tuple, t: pa.Table) -> pa.Table:
            v, n, rows = _start(t)
            child, vs, ns = [], [], []
            for at, h, o, c in _children(rows, sizes[i - 1]):
                v = max(v, at)
                child.append(at // sizes[i - 1]), vs.append(v), ns.append(n)
                j = int(np.searchsorted(h, v))
                v, n = int(o[j]), n + int(c[j])
            return table(key, child=np.array(child), v=np.array(vs), n=np.array(ns))

        return fn

    def number(key: tuple, t: pa.Table) -> pa.Table:
        v, n, rows = _start(t)
        x, rotations = np.sort(rows.column("x").to_numpy()), []
        i = int(np.searchsorted(x, v))
        while i < len(x):
            rotations.append(x[i])
            i = int(np.searchsorted(x, x[i] + w))
        gen = n + np.searchsorted(np.array(rotations, np.int64), x, "right")
        return table(key, x=x, gen=gen)

    def tile_of(size: int, c: str) -> Column:
        return F.floor(F.col(c) / size).cast("long")

    functions = []
    if levels > 1:  # with one tile all chains begin at its start
        functions.append(materialize(grouped(own.select(*keys, "x"), tile_of(sizes[0], "x"), read_off, "child", "hi", "out", "cnt"), "tile-functions"))
    for i in range(1, levels - 1):
        functions.append(materialize(grouped(functions[-1], tile_of(span, "child"), compose(i), "child", "hi", "out", "cnt"), "tile-functions"))
    # thresholds at the start of the one tile of the highest level: the origin counts as a rotation
    starts = own.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("child"), F.lit(w).cast("long").alias("v"), F.lit(0).cast("long").alias("n"))
    for i in range(levels - 1, 0, -1):
        told = functions[i - 1].withColumn("tile", tile_of(span, "child")).unionByName(starts.withColumnRenamed("child", "tile"), allowMissingColumns=True)
        starts = materialize(told.groupBy(*keys, "tile").applyInArrow(hand_down(i), schema("child", "v", "n")), "tile-starts")
    told = own.select(*keys, "x").withColumn("tile", tile_of(sizes[0], "x")).unionByName(starts.withColumnRenamed("child", "tile"), allowMissingColumns=True)
    gens = told.groupBy(*keys, "tile").applyInArrow(number, schema("x", "gen"))
    origins = own.groupBy(*keys).agg(F.min("o").alias("o")) if keys else own.agg(F.min("o").alias("o"))
    gens = gens.join(origins, keys) if keys else gens.withColumn("o", F.lit(origins.first()["o"]))
    return gens.select(*keys, (F.col("x") + F.col("o")).alias("received_at_ms"), F.col("gen").alias("_gen"))
