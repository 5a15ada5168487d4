"""Sources: the stored log table, raw container lines, structured batches."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from logloom.schema import LOG_SCHEMA

# Fixed value: longest accepted line (longer lines break the reader).
MAX_LINE_BYTES = 1 << 20

TABLE_SCHEMA = T.StructType(LOG_SCHEMA.fields + [
    T.StructField("terms", T.ArrayType(T.StringType()), True),
    T.StructField("log_date", T.DateType(), True),
])


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The stored log table (Parquet, partitioned by ``log_date``)."""
    return spark.read.schema(TABLE_SCHEMA).parquet(path)


def read_postings(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """The stored posting lists as occurrences (term, id, pos, log_date);
    with bounds on the id only the blocks that reach into them."""
    from logloom.operators.postings import BLOCK_SCHEMA, occurrences

    return occurrences(spark.read.schema(BLOCK_SCHEMA).parquet(path), first_id, last_id)


def _container_lines(text: DataFrame) -> DataFrame:
    """Lines of files below ``<root>/<namespace>/<pod>_<pod_uid>/<container>/``
    (folders may be spelled ``name=value``), with ``at``: the file's time,
    path and the byte its split starts at."""
    meta = F.col("_metadata")
    parts = F.split(meta["file_path"], "/")

    def folder(k: int):
        return F.regexp_replace(F.url_decode(F.element_at(parts, F.size(parts) - k)), "^[A-Za-z_]+=", "")

    return text.select(
        folder(3).alias("namespace"), F.regexp_extract(folder(2), "^(.*)_", 1).alias("pod"),
        F.substring_index(folder(2), "_", -1).alias("pod_uid"), folder(1).alias("container"),
        F.col("value").alias("line"), (F.unix_micros(meta["file_modification_time"]) * 1000).alias("ingest_ns"),
        F.struct(meta["file_modification_time"].alias("time"), meta["file_path"].alias("path"),
                 meta["file_block_start"].alias("block")).alias("at"))


def with_arrival(lines: DataFrame) -> DataFrame:
    """``at`` -> ``arrival``: an orderable struct, by file (older first), byte
    position of the split, row in the split.  For a batch, or inside
    ``foreachBatch``."""
    return lines.withColumn("arrival", F.struct("at.*", F.monotonically_increasing_id().alias("row"))).drop("at")


def read_raw_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Raw container log files -> RAW_SCHEMA rows and ``ingest_ns`` (the
    file's time, for lines without one); ``arrival`` follows the files' time,
    then the position in the file."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return with_arrival(_container_lines(reader.text(path)))


def stream_raw_text(spark: SparkSession, path: str, max_files: int = 100, pattern: str | None = None) -> DataFrame:
    """The same files as a stream for ``ingest_stream``, which adds ``arrival``."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return _container_lines(reader.text(path))


def split_oversize(df: DataFrame, max_bytes: int = MAX_LINE_BYTES, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): lines longer than ``max_bytes`` go to a reject output."""
    ok = F.octet_length(F.col(line)) <= max_bytes
    return df.where(ok), df.where(~ok)


def since(parsed: DataFrame, since_ns: int) -> DataFrame:
    """Inclusive lower bound on line time (where to start reading)."""
    return parsed.where(F.col("ts_ns") >= F.lit(since_ns))


def collect_passes(include: Iterable[str] = (), exclude: Iterable[str] = ("kube-system",), col: str = "namespace") -> Column:
    """Whether a namespace is collected; a null one only where all are."""
    include, exclude = list(include), list(exclude)
    cond = F.lit(True)
    if exclude:
        cond = cond & ~F.col(col).isin(exclude)
    if include:
        cond = cond & F.col(col).isin(include)
    return F.coalesce(cond, F.lit(False))


def collect_gate(df: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ("kube-system",),
                 col: str = "namespace") -> DataFrame:
    """Namespace gate: exclusion first and always wins; empty include = all."""
    return df.where(collect_passes(include, exclude, col))


def read_structured(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Already structured entries (no parsing), e.g. batches written by
    another collector, with the log-entry schema."""
    return spark.read.schema(LOG_SCHEMA).format(fmt).load(path)
