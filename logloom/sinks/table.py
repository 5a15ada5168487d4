"""The Parquet log table: append with first-write-wins and global ids.

Layout: ``log_date=YYYY-MM-DD/`` partitions, files range-partitioned and
sorted by (log_date, id) so id and time lookups skip row groups by min/max.
One writer per table (ids come from the current maximum).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logloom.functions.stem import terms
from logloom.operators.postings import BLOCK_SCHEMA, build_postings, merged_blocks, sorted_blocks, to_blocks
from logloom.session import checkpoint_root, scratch_path
from logloom.sinks import fs, swap
from logloom.sinks.appends import high_water, record_append
from logloom.sinks.unique import near
from logloom.functions.timestamps import ns_to_date
from logloom.operators.dedup import dedup_first
from logloom.schema import DEDUP_KEY, LOG_COLUMNS
from logloom.sources.logs import TABLE_SCHEMA

ROWS_PER_FILE = 5_000_000


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether rows were ever written (the append log alone is no table)."""
    return any(name.startswith("log_date=") for name, _ in fs.list_dirs(spark, path))


def _ranged(df: DataFrame, partitions: int | None, *cols: str) -> DataFrame:
    """Range-partitioned and sorted; without a number AQE sizes the parts."""
    dealt = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return dealt.sortWithinPartitions(*cols)


def write_log_table(df: DataFrame, path: str, mode: str = "append", partitions: int | None = None,
                    postings_path: str | None = None) -> None:
    """Write log rows (LOG_SCHEMA, ids set).  Rows are range-partitioned on
    (log_date, id): a day holding a third of the data is still spread over
    many writers, and every file covers a narrow id range.  The index column
    is computed after the shuffle: neither its sampling nor its rows carry it.
    The append is recorded first; ``postings_path``: where posting lists of
    the rows go, written before them.  Then the rows are staged with their
    index column, so no message is stemmed twice."""
    rows = _ranged(df.withColumn("log_date", ns_to_date("ts_ns")), partitions, "log_date", "id")
    if "terms" not in df.columns:
        rows = rows.withColumn("terms", terms(F.col("message")))
    seen = df.agg(F.min("id"), F.max("id"), F.collect_set(ns_to_date("ts_ns"))).first()  # days: few per append
    if seen[0] is None:
        return
    record_append(df.sparkSession, path, seen[0], seen[1], seen[2])
    rows = rows.select(*[f.name for f in TABLE_SCHEMA.fields])
    stage = scratch_path(df.sparkSession, "indexed") if postings_path else None
    try:
        if stage:
            rows.write.parquet(stage)
            rows = df.sparkSession.read.schema(TABLE_SCHEMA).parquet(stage).sortWithinPartitions("log_date", "id")
            write_postings(rows, postings_path, partitions)
        (rows.write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("log_date").parquet(path))
    finally:
        if stage:
            fs.delete(df.sparkSession, stage)


def max_id(spark: SparkSession, path: str) -> int:
    """Highest id given out: from the append log; a table without one is read."""
    known = high_water(spark, path)
    if known is not None:
        return known
    if not table_exists(spark, path):
        return 0
    row = spark.read.schema(TABLE_SCHEMA).parquet(path).agg(F.max("id")).first()
    return int(row[0] or 0)


def assign_ids(df: DataFrame, start_after: int, order: str = "arrival", stage: str | None = None) -> DataFrame:
    """Dense ids ``start_after + 1 ..`` in ``order``, without a global sort in
    one task: rows are range-partitioned on ``order`` and numbered inside
    their partition; a partition's offset is the sum of the row counts of
    the partitions before it (a tiny aggregate, one row per partition).

    The numbered rows are written to ``stage`` (or checkpointed reliably,
    under the shared folder), so counts and numbers come from one and the same
    partitioning even if a stage is retried or AQE would plan the two uses
    differently."""
    # (partition << 33) + row index
    ranged = _ranged(df, None, order).withColumn("__mono", F.monotonically_increasing_id())
    if stage:
        ranged.write.mode("overwrite").parquet(stage)
        ranged = df.sparkSession.read.parquet(stage)
    else:
        checkpoint_root(df.sparkSession)
        ranged = ranged.checkpoint(eager=True)
    ranged = ranged.withColumns({"__pid": F.shiftright(F.col("__mono"), 33),
                                 "__pos": F.col("__mono") - F.shiftleft(F.shiftright(F.col("__mono"), 33), 33) + 1})
    counts = ranged.groupBy("__pid").agg(F.count("*").alias("__n"))
    offsets = counts.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off"))
    # one row per partition: bounded by the partition count, safe to broadcast
    out = ranged.join(F.broadcast(offsets), "__pid")
    return out.withColumn("id", F.lit(start_after) + F.col("__off") + F.col("__pos")).drop(
        "__pid", "__pos", "__off", "__mono")


def new_rows(batch: DataFrame, existing: DataFrame | None, order: str = "arrival") -> DataFrame:
    """First write wins inside the batch, then against stored rows.  Only
    stored rows of the batch's own days, and there only between the batch's
    first and last time of the day, are read: times are part of the key, so
    no other row can be equal.  The bounds come from an aggregate over the
    batch, one row per day."""
    first = dedup_first(batch, order=order)
    if existing is None:
        return first
    days = [tuple(r) for r in batch.groupBy(ns_to_date("ts_ns").alias("day")).agg(
        F.min("ts_ns"), F.max("ts_ns")).collect()]
    if not days:
        return first
    first = first.withColumn("log_date", ns_to_date("ts_ns"))
    stored = existing.where(near(days, F.col("log_date"), F.col("ts_ns"))).select(*DEDUP_KEY, "log_date")
    return first.join(stored, on=[*DEDUP_KEY, "log_date"], how="left_anti").drop("log_date")


def append_new(spark: SparkSession, batch: DataFrame, path: str, stage_dir: str, order: str = "arrival",
               postings_path: str | None = None, counts: dict[str, Column] | None = None, also: list[str] | None = None) -> dict:
    """Append a batch of parsed rows (no ids) to the table; a re-delivered
    batch adds nothing.  Returns offered / inserted counts, and ``counts``:
    aggregates over the offered rows and their columns ``also``.

    The batch is staged first: that cuts the (large) parse expressions out of
    the join's plan and makes the id assignment deterministic on retry.  The
    stage is removed once the rows are in the table."""
    stage = stage_dir.rstrip("/")
    try:
        return _append_staged(spark, batch, path, stage, order, postings_path, counts or {}, also or [])
    finally:
        fs.delete(spark, stage)


def _append_staged(spark, batch, path, stage, order, postings_path, counts, also) -> dict:
    cols = [c for c in batch.columns if c in LOG_COLUMNS or c == order]
    batch.select(*cols, *also).write.mode("overwrite").parquet(stage + "/in")
    offered_rows = spark.read.parquet(stage + "/in")
    offered = offered_rows.agg(F.count("*").alias("offered"), *[c.alias(n) for n, c in counts.items()]).first().asDict()
    staged_in = offered_rows.select(*cols)
    existing = spark.read.schema(TABLE_SCHEMA).parquet(path) if table_exists(spark, path) else None
    new_rows(staged_in, existing, order=order).write.mode("overwrite").parquet(stage + "/batch")
    staged = spark.read.parquet(stage + "/batch")
    inserted = staged.count()
    if inserted:
        with_ids = assign_ids(staged, max_id(spark, path), order=order, stage=stage + "/numbered")
        write_log_table(with_ids.select(*LOG_COLUMNS), path, postings_path=postings_path)
    return offered | {"inserted": inserted}


def write_postings(logs: DataFrame, path: str, partitions: int | None = None) -> None:
    """Posting blocks of stored rows (``logs`` must carry ``terms`` and
    ``log_date``), written beside the table and partitioned the same way.
    Files are sorted by term so a term lookup skips row groups."""
    (sorted_blocks(to_blocks(build_postings(logs)), partitions).write.mode("append")
     .option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("log_date").parquet(path))


#: Files of a day's posting blocks from which :func:`merge_postings` writes it anew.
MERGE_FILES = 8


def merge_postings(spark: SparkSession, table_path: str, path: str, stage_root: str, files: int = MERGE_FILES) -> int:
    """Write the blocks of every day with ``files`` files or more anew, the
    blocks that appends wrote for one range of ids as one; the number of
    files replaced.  Appends may go on meanwhile."""
    name = swap.stage_name(table_path, "merge")
    done = swap.resume(spark, table_path, stage_root)
    if name in done:
        return done[name]
    root, stage = path.rstrip("/"), f"{stage_root.rstrip('/')}/{name}"
    days = {day: found for day, found in swap.day_files(spark, root).items() if len(found) >= files}
    found = [f for names in days.values() for f in names]
    if not found:
        return 0
    blocks = spark.read.option("basePath", root).schema(BLOCK_SCHEMA).parquet(*found)
    merged = merged_blocks(blocks)
    steps = swap.replacement_of_days(spark, merged, root, days, f"{stage}/blocks", f"merged-{uuid.uuid4().hex[:8]}")
    return swap.commit(spark, stage, steps, len(found))
