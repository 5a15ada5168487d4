"""Store statistics and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.schema import DEDUP_KEY


def stats(df: DataFrame) -> DataFrame:
    """One row: total rows, oldest and newest ns time (NULL when empty)."""
    return df.agg(F.count("*").cast("long").alias("total"),
                  F.min("ts_ns").alias("oldest_ns"), F.max("ts_ns").alias("newest_ns"))


def disk_size(spark: SparkSession, path: str) -> DataFrame:
    """Bytes on disk of the data files below ``path`` (one row): from the
    listing, no file is opened."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(path).select("length"))
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"),
                     F.count("*").cast("long").alias("files"))


def list_distinct(df: DataFrame, col: str) -> DataFrame:
    """Distinct values, binary order (partial aggregation before the shuffle)."""
    return df.select(col).distinct().orderBy(col)


def list_namespaces(df: DataFrame) -> DataFrame:
    return list_distinct(df, "namespace")


def list_containers(df: DataFrame) -> DataFrame:
    return list_distinct(df, "container")


def container_stats(parsed: DataFrame, key=("namespace", "pod", "pod_uid", "container")) -> DataFrame:
    """Per container: lines read, lines with a time of their own, errors and
    worse, last line time."""
    return parsed.groupBy(*key).agg(
        F.count("*").cast("long").alias("lines"),
        F.count_if(F.col("ts_ns") != F.col("ingest_ns")).alias("with_time"),
        F.count_if(F.col("severity") >= 5).alias("errors"),
        F.max("ts_ns").alias("last_ts_ns"),
    )


def ingest_stats(parsed: DataFrame) -> DataFrame:
    """One row: lines read, with a time of their own, with attributes, errors
    and worse, entries left after dedup, last line time."""
    return parsed.agg(
        F.count("*").cast("long").alias("lines_read"),
        F.count_if(F.col("ts_ns") != F.col("ingest_ns")).alias("with_time"),
        F.count_if(F.col("attributes").isNotNull()).alias("structured"),
        F.count_if(F.col("severity") >= 5).alias("errors"),
        F.countDistinct(*DEDUP_KEY).cast("long").alias("entries"),
        F.max("ts_ns").alias("last_ts_ns"),
    )


# --------------------------------------------------- summaries of a stored table

SUMMARY = ("file string, rows bigint, oldest_ns bigint, newest_ns bigint, namespaces array<string>, containers array<string>")


def _table_files(spark, path: str) -> DataFrame:
    """(file) of the table's data files, as folder and name; no file is opened."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(path).select("path"))
    return files.select(_short("path").alias("file")).where(F.col("file").startswith("log_date="))


def _short(name: str):
    return F.url_decode(F.concat_ws("/", F.slice(F.split(name, "/"), -2, 2)))


def summarise(spark, path: str) -> int:
    """Keep the summary of a stored table up to date: the data files that it
    does not have yet (new ones, or rewritten by retention and repair) are read
    once; the number of them.  A file never changes, so its summary holds."""
    new = _table_files(spark, path)
    known = _summaries(spark, path)
    if known is not None:
        new = new.join(known.select("file"), "file", "left_anti")
    names = [r.file for r in new.collect()]  # files since the last run
    if names:
        from logloom.sources.logs import TABLE_SCHEMA

        root = path.rstrip("/")
        rows = spark.read.option("basePath", root).schema(TABLE_SCHEMA).parquet(*[f"{root}/{n}" for n in names])
        found = rows.withColumn("path", F.input_file_name()).groupBy(_short("path").alias("file"))
        found.agg(F.count("*").alias("rows"), F.min("ts_ns").alias("oldest_ns"), F.max("ts_ns").alias("newest_ns"),
                  F.collect_set("namespace").alias("namespaces"), F.collect_set("container").alias("containers")
                  ).write.mode("append").parquet(f"{root}/_summary")
    return len(names)


def _summaries(spark, path: str) -> DataFrame | None:
    from logloom.sinks import fs

    at = f"{path.rstrip('/')}/_summary"
    return spark.read.schema(SUMMARY).parquet(at) if fs.exists(spark, at) else None


def stored_summary(spark, path: str) -> DataFrame:
    """The summaries of the table's present files (:func:`summarise` first);
    a file summarised twice counts once."""
    known = _summaries(spark, path)
    if known is None:
        return spark.createDataFrame([], SUMMARY)
    return known.dropDuplicates(["file"]).join(_table_files(spark, path), "file", "left_semi")


def stored_stats(spark, path: str) -> DataFrame:
    """As :func:`stats`, without opening a data file."""
    return stored_summary(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
                                           F.min("oldest_ns").alias("oldest_ns"), F.max("newest_ns").alias("newest_ns"))


def stored_names(spark, path: str, column: str) -> DataFrame:
    """Distinct ``namespaces`` or ``containers`` in binary order, likewise."""
    return stored_summary(spark, path).select(F.explode(column).alias(column[:-1])).distinct().orderBy(column[:-1])
