"""Rows of micro-batches below a folder, a folder per epoch, old ones merged.

An epoch that is delivered again replaces its own folder.  Epochs start at 0
with each checkpoint, so a folder belongs to the streaming query that wrote it
first: another query (one started with a fresh checkpoint) is refused before it
overwrites anything.  ``MERGE`` folders before the current one are written as
one, and as many of these as one again, so few folders are ever open and a row
is rewritten a few times however long the query runs.  Only the current epoch
can be replayed.  A folder gets its name when it is complete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.sinks import fs

MERGE = 64


def query_id(spark: SparkSession) -> str | None:
    """Id of the streaming query whose batch is being written: kept in its
    checkpoint, so the same after a restart.  None outside of a stream."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


class EpochLog:
    """``fold``: what the merge makes of the rows (with their ``epoch``) of
    several epochs, e.g. only the latest of each key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, fold: Callable[[DataFrame], DataFrame] | None = None,
                 merge: int = MERGE):
        self.spark, self.path, self.schema, self.fold, self.merge = spark, path.rstrip("/"), f"{schema}, epoch bigint", fold, merge

    def _folders(self) -> tuple[list[tuple[int, int, str]], list[str]]:
        """(level, last epoch, folder) of all that count, oldest first, and the
        names of everything.  What a merge took in, but did not get to delete,
        does not count."""
        names = dict(fs.list_dirs(self.spark, self.path))
        found = sorted((int(n[1:3]), int(n[4:]), f) for n, f in names.items() if n[0] == "m")
        live = [f for f in found if not any(g[0] > f[0] and g[1] >= f[1] for g in found)]
        return sorted(live, key=lambda f: f[1]), list(names)

    def _own(self, names: list[str]) -> None:
        writer = query_id(self.spark) or "batch"
        owners = [n for n in names if n.startswith("_writer-")]
        if not owners:
            fs.make_dir(self.spark, f"{self.path}/_writer-{writer}")
        elif owners != [f"_writer-{writer}"]:
            raise ValueError(f"{self.path} was written by the streaming query {owners[0][8:]}: a query with another "
                             "checkpoint needs a folder of its own")

    def _put(self, rows: DataFrame, level: int, last: int) -> None:
        at, staged = f"{self.path}/m{level:02d}-{last:012d}", f"{self.path}/_staged"
        rows.write.mode("overwrite").parquet(staged)
        fs.delete(self.spark, at)
        if not fs.rename(self.spark, staged, at):
            raise RuntimeError(f"could not rename {staged} to {at}")

    def write(self, rows: DataFrame, epoch: int) -> None:
        self._own(self._folders()[1])
        self._put(rows.withColumn("epoch", F.lit(epoch).cast("bigint")), 0, epoch)
        level = 0
        while True:
            old = [f for f in self._folders()[0] if f[0] == level and f[1] < epoch]
            if len(old) < self.merge:
                return
            whole = self._read([f for _, _, f in old])
            level += 1
            self._put(self.fold(whole) if self.fold else whole, level, old[-1][1])
            for _, _, folder in old:
                fs.delete(self.spark, folder)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        """All rows with their ``epoch``."""
        return self._read([f for _, _, f in self._folders()[0]])
