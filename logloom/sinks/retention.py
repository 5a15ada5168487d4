"""Retention: delete rows older than a cutoff.

Whole ``log_date`` partitions before the cutoff day go; of the boundary day
only the files that hold rows to delete are rewritten.  What a run will do is
staged first and then taken step by step (:mod:`logloom.sinks.swap`): a run
that died is finished by the next one, and files of an append in between stay
as they are.
"""

from __future__ import annotations

import datetime as _dt
import urllib.parse

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from logloom.operators.postings import BLOCK_SCHEMA, sorted_blocks, without_ids
from logloom.sinks import swap
from logloom.sources.logs import TABLE_SCHEMA

NS_PER_DAY = 86_400 * 1_000_000_000
RUNS_SCHEMA = T.StructType([
    T.StructField("run_ns", T.LongType(), False),
    T.StructField("cutoff_ns", T.LongType(), False),
    T.StructField("deleted", T.LongType(), False),
    T.StructField("error", T.StringType(), True),
])


def retention_keep(df: DataFrame, cutoff_ns: int) -> DataFrame:
    """Rows that survive: time >= cutoff (strictly older rows go)."""
    return df.where(F.col("ts_ns") >= F.lit(cutoff_ns))


def retention_counts(df: DataFrame, cutoff_ns: int) -> DataFrame:
    """One row: deleted, kept."""
    old = F.col("ts_ns") < F.lit(cutoff_ns)
    return df.agg(F.sum(F.when(old, 1).otherwise(0)).cast("long").alias("deleted"),
                  F.sum(F.when(old, 0).otherwise(1)).cast("long").alias("kept"))


def apply_retention(spark: SparkSession, path: str, cutoff_ns: int, stage_root: str,
                    postings_path: str | None = None) -> int:
    """Delete rows with ts_ns < cutoff from the table at ``path`` (and their
    posting lists); returns the number of deleted rows.

    Jobs of the table that died after staging are finished first; if one of
    them was a run with this cutoff, its number of rows is returned."""
    name = swap.stage_name(path, f"retention-{cutoff_ns}")
    done = swap.resume(spark, path, stage_root)
    if name in done:
        return done[name]
    stage = f"{stage_root.rstrip('/')}/{name}"
    steps, deleted = _plan(spark, path.rstrip("/"), cutoff_ns, stage, postings_path)
    return swap.commit(spark, stage, steps, deleted) if deleted else 0


def _plan(spark: SparkSession, root: str, cutoff_ns: int, stage: str, postings_path: str | None) -> tuple[list, int]:
    """The steps of a run and the number of rows that go.

    The table's files are listed before those of the posting lists: lists are
    written before their rows, so the rows of every listed file have theirs
    in listed files.  Of the boundary day's lists only those of deleted rows
    are left out: an append whose rows are not there yet keeps its lists."""
    day = _dt.date(1970, 1, 1) + _dt.timedelta(days=cutoff_ns // NS_PER_DAY)
    files = swap.day_files(spark, root)
    old, tag = F.col("ts_ns") < F.lit(cutoff_ns), f"kept-{cutoff_ns}"

    def read(paths: list[str]) -> DataFrame:
        return spark.read.option("basePath", root).schema(TABLE_SCHEMA).parquet(*paths)

    gone = [f for d, names in files.items() if d < day for f in names]
    # of the boundary day only files with rows that go are replaced
    mixed = files.get(day, [])
    per_file = read(mixed).where(old).groupBy(F.input_file_name().alias("file")).agg(
        F.count("*").alias("n")).collect() if mixed else []  # one row per file
    dropped = {urllib.parse.unquote(r.file).rsplit("/", 1)[1] for r in per_file}
    replaced = [f for f in mixed if f.rsplit("/", 1)[1] in dropped]
    deleted = sum(r.n for r in per_file) + (read(gone).count() if gone else 0)
    if deleted == 0:
        return [], 0
    steps = swap.removal(gone)
    if replaced:
        kept = read(replaced).where(~old).drop("log_date").sortWithinPartitions("id")
        steps += swap.replacement(spark, kept, replaced, f"{stage}/rows", tag)
    if postings_path:
        at = postings_path.rstrip("/")
        lists = swap.day_files(spark, at)
        steps += swap.removal([f for d, names in lists.items() if d < day for f in names])
        if replaced and lists.get(day):
            blocks = spark.read.option("basePath", at).schema(BLOCK_SCHEMA).parquet(*lists[day])
            kept = without_ids(blocks, read(replaced).where(old).select("id"))
            steps += swap.replacement(spark, sorted_blocks(kept).drop("log_date"), lists[day], f"{stage}/postings", tag)
    return steps, deleted


def retention_job(spark: SparkSession, path: str, now_ns: int, days: int, stage_root: str, runs_path: str,
                  postings_path: str | None = None) -> int:
    """One retention run: rows older than ``days`` before ``now_ns`` go (0
    days: retention is off, nothing runs).  The run, its count and its error,
    if there was one, are recorded; an error is raised again."""
    if days <= 0:
        return 0
    cutoff_ns = now_ns - days * NS_PER_DAY
    try:
        deleted = apply_retention(spark, path, cutoff_ns, stage_root, postings_path)
    except Exception as e:
        record_run(spark, runs_path, now_ns, cutoff_ns, 0, str(e))
        raise
    record_run(spark, runs_path, now_ns, cutoff_ns, deleted)
    return deleted


def record_run(spark: SparkSession, runs_path: str, run_ns: int, cutoff_ns: int, deleted: int,
               error: str | None = None) -> None:
    spark.createDataFrame([(run_ns, cutoff_ns, deleted, error)], RUNS_SCHEMA).write.mode("append").parquet(runs_path)


def retention_stats(runs: DataFrame) -> DataFrame:
    """Runs, total deleted, time of the last run, last error."""
    return runs.agg(
        F.count("*").cast("long").alias("runs"),
        F.coalesce(F.sum("deleted"), F.lit(0)).cast("long").alias("total_deleted"),
        F.max("run_ns").alias("last_run_ns"),
        F.max_by("error", "run_ns").alias("last_error"),
    )
