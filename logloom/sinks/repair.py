"""Repair of a stored table: repeated entries and entries without their index.

Tables written around :func:`append_new` (imports, older writers) can hold an
entry twice, or entries whose ``terms`` were never computed.  The job finds
both, rewrites only the files that hold such entries, and leaves appends that
go on meanwhile alone (:mod:`logloom.sinks.swap`); a job that died is finished
by the next one.
"""

from __future__ import annotations

import urllib.parse

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.functions.stem import terms
from logloom.operators.postings import BLOCK_SCHEMA, build_postings, sorted_blocks, to_blocks, without_ids
from logloom.schema import DEDUP_KEY
from logloom.session import scratch_path
from logloom.sinks import fs, swap
from logloom.sources.logs import TABLE_SCHEMA


def repeated_ids(table: DataFrame) -> DataFrame:
    """(log_date, id) of the entries to drop: of each content key all but the
    smallest id.

    Two 64-bit hashes decide which keys are looked at: only their rows, not the
    messages of the whole table, are shuffled and compared in full."""
    hashes = [F.xxhash64(*DEDUP_KEY).alias("h1"), F.hash(*DEDUP_KEY).alias("h2")]
    keyed = table.select("log_date", "id", *hashes)
    often = keyed.groupBy("log_date", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    rows = table.select("log_date", "id", *DEDUP_KEY, *hashes).join(often, ["log_date", "h1", "h2"], "left_semi")
    first = rows.groupBy("log_date", *DEDUP_KEY).agg(F.min("id").alias("first_id"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ["log_date", *DEDUP_KEY]]
    met = rows.alias("r").join(first.alias("f"), [*same, F.col("r.id") > F.col("f.first_id")])
    return met.select("r.log_date", "r.id")


def repair_table(spark: SparkSession, path: str, stage_root: str, postings_path: str | None = None) -> int:
    """Drop repeated entries (the smallest id stays) and give entries without
    ``terms`` theirs; the number of entries dropped or indexed.  Posting lists
    follow.  Only files with such entries are replaced."""
    name = swap.stage_name(path, "repair")
    done = swap.resume(spark, path, stage_root)
    if name in done:
        return done[name]
    root, stage = path.rstrip("/"), f"{stage_root.rstrip('/')}/{name}"
    files = swap.day_files(spark, root)
    everything = [f for names in files.values() for f in names]
    if not everything:
        return 0
    table = spark.read.option("basePath", root).schema(TABLE_SCHEMA).parquet(*everything)
    work = scratch_path(spark, "repair")
    try:
        repeated_ids(table).write.parquet(f"{work}/drop")
        drop = spark.read.parquet(f"{work}/drop")
        named = table.select("log_date", "id", F.col("terms").isNull().alias("bare"), F.input_file_name().alias("file"))
        marked = named.join(drop.withColumn("drop", F.lit(True)), ["log_date", "id"], "left").where("bare or drop")
        touched = marked.groupBy("log_date", "file").agg(
            F.count("*").alias("n"), F.count_if("drop").alias("drops")).collect()  # one row per file to replace
        if not touched:
            return 0
        names = {urllib.parse.unquote(r.file).rsplit("/", 1)[1] for r in touched}
        replaced = {day: [f for f in files[day] if f.rsplit("/", 1)[1] in names] for day in {r.log_date for r in touched}}
        steps = _steps(spark, root, replaced, drop, stage, postings_path)
        return swap.commit(spark, stage, steps, sum(r.n for r in touched))
    finally:
        fs.delete(spark, work)


def _steps(spark, root: str, replaced: dict, drop: DataFrame, stage: str, postings_path: str | None) -> list[tuple]:
    old = [f for files in replaced.values() for f in files]
    rows = spark.read.option("basePath", root).schema(TABLE_SCHEMA).parquet(*old).join(drop.select("id"), "id", "left_anti")
    bare = F.col("terms").isNull()
    columns = [f.name for f in TABLE_SCHEMA.fields]
    indexed = rows.where(bare).withColumn("terms", terms(F.col("message"))).select(*columns)
    indexed.write.mode("overwrite").parquet(f"{stage}/indexed")  # stemmed once
    indexed = spark.read.schema(TABLE_SCHEMA).parquet(f"{stage}/indexed")
    kept = rows.where(~bare).select(*columns).unionByName(indexed)
    kept = kept.repartitionByRange("log_date", "id").sortWithinPartitions("log_date", "id")
    steps = swap.replacement_of_days(spark, kept, root, replaced, f"{stage}/rows", "repaired")
    if postings_path:
        at = postings_path.rstrip("/")
        lists = {day: files for day, files in swap.day_files(spark, at).items() if day in replaced}
        found = [f for files in lists.values() for f in files]
        blocks = spark.read.option("basePath", at).schema(BLOCK_SCHEMA).parquet(*found) if found else \
            spark.createDataFrame([], BLOCK_SCHEMA)
        merged = without_ids(blocks, drop).unionByName(to_blocks(build_postings(indexed)))
        steps += swap.replacement_of_days(spark, sorted_blocks(merged), at, lists, f"{stage}/postings", "repaired")
    return steps
