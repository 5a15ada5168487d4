"""The append log of a table: which ids and days every append wrote.

One row per append, below the table in a folder that readers of the table
skip; older appends are merged by ranges of ids.  It is written before the rows: an append that dies leaves a gap in
the ids and never two rows with one id.  The log answers "highest id" and
"which days can hold these ids" without opening the table's files.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.functions.timestamps import floor_div
from logloom.sinks import fs

_FOLDER = "_appends"
SCHEMA = "min_id bigint, max_id bigint, days array<date>"
#: Appends of so many ids become one row when the log is written anew.
MERGE_IDS = 1 << 20
#: Files of one generation of the log; then it is written anew as one file.
COMPACT_FILES = 64


def _generations(spark: SparkSession, path: str) -> list[str]:
    found = fs.list_dirs(spark, f"{path}/{_FOLDER}")
    done = [full for name, full in found if name.startswith("g") and fs.exists(spark, f"{full}/_SUCCESS")]
    return sorted(done)


def read_appends(spark: SparkSession, path: str) -> DataFrame | None:
    """(min_id, max_id, days) per append; None where the table keeps no log."""
    done = _generations(spark, path)
    return spark.read.schema(SCHEMA).parquet(done[-1]) if done else None


def record_append(spark: SparkSession, path: str, min_id: int, max_id: int, days: list) -> None:
    done = _generations(spark, path)
    row = spark.createDataFrame([(min_id, max_id, sorted(days))], SCHEMA).coalesce(1)
    if done and len(fs.list_dirs(spark, done[-1])) < COMPACT_FILES:
        row.write.mode("append").parquet(done[-1])
        return
    number = int(done[-1].rsplit("/g", 1)[1]) + 1 if done else 0
    if done:
        row = _merged(spark, path, spark.read.schema(SCHEMA).parquet(done[-1])).unionByName(row).coalesce(1)
    row.write.mode("overwrite").parquet(f"{path}/{_FOLDER}/g{number:08d}")
    for old in done:
        fs.delete(spark, old)


def _merged(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    """Appends of one range of ids as one row; rows of which no day is left go,
    but for the last one (it holds the highest id)."""
    days = [_dt.date.fromisoformat(n.split("=", 1)[1]) for n, _ in fs.list_dirs(spark, path) if n.startswith("log_date=")]
    top = log.agg(F.max("max_id")).first()[0]
    here = F.arrays_overlap("days", F.array(*[F.lit(d) for d in days])) if days else F.lit(False)
    kept = log.where(F.coalesce(here, F.lit(False)) | (F.col("max_id") == top))
    ranges = kept.groupBy(floor_div(F.col("min_id"), MERGE_IDS).alias("range"))
    return ranges.agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"),
                      F.sort_array(F.array_distinct(F.flatten(F.collect_list("days")))).alias("days")).drop("range")


def high_water(spark: SparkSession, path: str) -> int | None:
    """Highest id ever given out; None where the table keeps no log."""
    log = read_appends(spark, path)
    return None if log is None else int(log.agg(F.max("max_id")).first()[0] or 0)


def ranges(spark: SparkSession, path: str, after: int | None = None, before: int | None = None, ascending: bool = False,
           most: int | None = None) -> list[tuple[int, int, list]] | None:
    """(min_id, max_id, days) of the appends with ids above ``after`` and
    below ``before``, newest ids first (or oldest), at most ``most`` of them."""
    log = read_appends(spark, path)
    if log is None:
        return None
    if after is not None:
        log = log.where(F.col("max_id") > after)
    if before is not None:
        log = log.where(F.col("min_id") < before)
    log = log.orderBy(F.col("min_id").asc() if ascending else F.col("max_id").desc())
    return [(r.min_id, r.max_id, r.days) for r in (log.limit(most) if most else log).toLocalIterator()]
