"""A levelled log of changed rows, for streams whose result is the last version of each key.

Every micro-batch writes its changed rows as a run of the lowest level, in a folder of its own. When ``fan`` runs of a level are complete, one
aggregation keeps the last version of each key in them as a run of the next level. Which runs hold the state after a batch follows from
the batch's number alone (its digits in base ``fan``), so there is no manifest to lose: at most ``fan - 1`` runs of each level,
however many batches there were, and each change is rewritten once a level. A batch that runs again overwrites the same folders with the
same rows. Runs that a batch has merged are removed by the batch after it, when they can't be asked for any more.

``live`` (a condition on a row, told the batch) drops rows that no later batch needs, as levels are merged and as the state is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BATCH = "_batch"


class ChangeLog:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], fan: int = 8, live: Callable[[int], Column] | None = None) -> None:
        self.spark, self.path, self.keys, self.fan, self.live = spark, path, list(keys), fan, live
        self.schema = T.StructType([*schema, T.StructField(BATCH, T.LongType())])
        self.values = [c for c in schema.names if c not in self.keys]

    def _folder(self, level: int, run: int) -> str:
        return f"{self.path}/level-{level:02d}-run-{run:08d}"

    def runs(self, batch: int) -> list[str]:
        """Folders that hold the state after ``batch`` (none before the first)."""
        out, at, size, level = [], 0, 1, 0
        while size * self.fan <= batch + 1:
            size, level = size * self.fan, level + 1
        while at <= batch:
            while at + size > batch + 1:
                size, level = size // self.fan, level - 1
            out.append(self._folder(level, at // size))
            at += size
        return out

    def _merges(self, batch: int) -> Iterator[tuple[int, int]]:
        """(level, run) that ``batch`` completes."""
        size, level = self.fan, 1
        while (batch + 1) % size == 0:
            yield level, batch // size
            size, level = size * self.fan, level + 1

    def _latest(self, folders: list[str], batch: int) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.values, BATCH), BATCH).alias("_v")).select(*self.keys, "_v.*")
        return last if self.live is None else last.where(self.live(batch))

    def write(self, changes: DataFrame, batch: int) -> None:
        for level, run in self._merges(batch - 1) if batch else ():
            for k in range(run * self.fan, (run + 1) * self.fan):
                self._remove(self._folder(level - 1, k))
        names = [f.name for f in self.schema]
        changes.withColumn(BATCH, F.lit(batch).cast("long")).select(names).write.mode("overwrite").parquet(self._folder(0, batch))
        for level, run in self._merges(batch):
            parts = [self._folder(level - 1, k) for k in range(run * self.fan, (run + 1) * self.fan)]
            self._latest(parts, batch).select(names).write.mode("overwrite").parquet(self._folder(level, run))

    def read(self, batch: int) -> DataFrame:
        """The last version of each key after ``batch``."""
        if batch < 0:
            return self.spark.createDataFrame([], self.schema).drop(BATCH)
        return self._latest(self.runs(batch), batch).drop(BATCH)

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
