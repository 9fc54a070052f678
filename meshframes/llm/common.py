"""Helpers shared by the training-data operators: table access, scratch tables, Arrow columns."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, types as T

from meshframes.session import scratch_path

#: A task gets Arrow batches of about so many bytes (one row at least), unless the session sets a limit of its own.
BATCH_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back: the lineage is
    cut, a lost executor costs a reread, and later passes read only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def release() -> None:
    """Gives memory that a task has freed back to the system; a Python worker lives on between tasks and would hold its highest mark."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


_kept: list[Callable] = []
_stage = -1


def kept_in_stage(make: Callable) -> Callable:
    """A cache of ``make`` whose values a Python worker keeps between tasks of one stage, and forgets when it begins a task of another."""
    cached = functools.cache(make)
    _kept.append(cached)
    return cached


def _begin() -> None:
    global _stage
    context = TaskContext.get()
    if context is None or context.stageId() == _stage:
        return
    _stage = context.stageId()
    if any(c.cache_info().currsize for c in _kept):
        for c in _kept:
            c.cache_clear()
        release()


def releasing(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` with :func:`release` at its end; what the worker keeps of another stage (:func:`kept_in_stage`) goes before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        yield from task(batches)
        release()

    return run


def in_tasks(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` by a :func:`releasing` task, in batches of about :data:`BATCH_BYTES`: ten thousand whole texts may be any size."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(releasing(task), schema)


def with_arrow_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns computed per Arrow batch by ``make()(*input arrays)``.

    All columns of ``df`` (or those in ``keep``) pass through; one with the name of a new
    column is replaced by it. ``make`` runs once per task."""
    names = [f.name for f in fields]
    passed = [c for c in (df.columns if keep is None else keep) if c not in names]
    read = list(dict.fromkeys([*passed, *inputs]))
    schema = T.StructType([*(df.schema[c] for c in passed), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            new = fn(*(b.column(c) for c in inputs))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), *new], names=[*passed, *names])

    return in_tasks(df.select(*[f"`{c}`" for c in read]), run, schema)


def blocks(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to ``most`` or so (one item at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of consecutive rows with the same values of ``keys`` (sorted partitions), as slices of the batches."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        values = list(zip(*(b.column(k).to_pylist() for k in keys)))
        s = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[s]:
                if held and values[s] != key:
                    yield key, held
                    held = []
                key = values[s]
                held.append(b.slice(s, i - s))
                s = i
    if held:
        yield key, held
