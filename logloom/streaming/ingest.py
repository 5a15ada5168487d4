"""Streaming ingest: raw lines -> parse -> first-write-wins append.

Each micro-batch goes through :func:`logloom.sinks.table.append_new`: the
anti-join against stored rows makes a replayed batch (after a failure and
restart from the checkpoint) insert nothing, so delivery is at least once
and the table stays duplicate-free.  Back-pressure comes from
``maxFilesPerTrigger``; the trigger interval bounds latency.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import types as T

from logloom.functions.timestamps import ns_to_ts
from logloom.operators.parse import parse_lines, to_log_entry
from logloom.schema import DEDUP_KEY, LOG_COLUMNS, RAW_SCHEMA
from logloom.sinks.epochs import EpochLog
from logloom.sinks.table import append_new
from logloom.sinks.unique import rows_by_content
from logloom.sources.logs import MAX_LINE_BYTES, collect_passes, since, with_arrival

RAW_STREAM_SCHEMA = T.StructType(RAW_SCHEMA.fields + [T.StructField("ingest_ns", T.LongType(), False)])


def stream_raw_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Raw line files (RAW_STREAM_SCHEMA, Parquet) as a stream."""
    return spark.readStream.schema(RAW_STREAM_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def with_structured(raw: DataFrame, structured: DataFrame) -> DataFrame:
    """One stream of raw lines and of entries that need no parsing (log-entry
    columns and ``arrival``): entries have a null ``line``."""
    return raw.unionByName(structured, allowMissingColumns=True)


def _entries(batch: DataFrame) -> DataFrame:
    """Log entries of a micro-batch: parsed lines, and structured rows as they
    are; ``own_time``: whether the time came with the line."""
    cols = [c for c in LOG_COLUMNS if c != "id"] + ["arrival", "own_time"]
    parsed = to_log_entry(parse_lines(batch.where(F.col("line").isNotNull()).select(*_raw_columns(batch))))
    parsed = parsed.withColumn("own_time", F.col("ts_ns") != F.col("ingest_ns"))
    if "ts_ns" not in batch.columns:
        return parsed.select(*cols)
    ready = batch.where(F.col("line").isNull()).withColumn("own_time", F.lit(True))
    return parsed.select(*cols).unionByName(ready.select(*cols))


def _spread(batch: DataFrame) -> DataFrame:
    """Lines dealt over as many tasks as shuffles have: a batch of few files is
    few tasks, however many lines they hold, and parsing is the work."""
    return batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _raw_columns(batch: DataFrame) -> list[str]:
    return [f.name for f in RAW_STREAM_SCHEMA if f.name in batch.columns]


#: What an epoch of the ingest counts.
COUNTERS = ("lines bigint, bytes bigint, gated bigint, rejected bigint, entries bigint, with_time bigint, "
            "with_attributes bigint, errors bigint, last_ts_ns bigint, inserted bigint")


def ingest_counters(spark: SparkSession, path: str) -> DataFrame:
    """The live counters of an ingest (its ``counters_path``), a row per
    epoch: lines read and their bytes, lines that the namespace gate left out,
    lines too long, entries offered to the table, of them with a time of their
    own, with attributes, errors and worse, newest time, rows inserted."""
    return EpochLog(spark, path, COUNTERS, _added).read()


def _added(log: DataFrame) -> DataFrame:
    """Old epochs as one row."""
    names = [c.split()[0] for c in COUNTERS.split(", ")]
    return log.agg(*[(F.max if n == "last_ts_ns" else F.sum)(n).alias(n) for n in names], F.max("epoch").alias("epoch"))


def ingest_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: the counters over all epochs, and how many rows were repeats."""
    total = _added(ingest_counters(spark, path)).drop("epoch")
    return total.withColumn("repeated", F.col("entries") - F.col("inserted"))


def ingest_stream(spark: SparkSession, raw: DataFrame, table_path: str, checkpoint: str,
                  trigger: dict | None = None, max_line_bytes: int = MAX_LINE_BYTES,
                  rejects_path: str | None = None, include: tuple = (), exclude: tuple = (),
                  since_ns: int | None = None, postings_path: str | None = None,
                  counters_path: str | None = None) -> StreamingQuery:
    """Start the ingest pipeline; ``trigger`` e.g. ``{"processingTime": "5 seconds"}``
    (default) or ``{"availableNow": True}``.  Lines longer than
    ``max_line_bytes`` go to ``rejects_path`` (default: beside the checkpoint)
    instead of breaking the stream.  ``include`` / ``exclude``: namespace gate
    before parsing; ``since_ns``: lines before this time are left out.

    A micro-batch is read once and kept while its lines are counted and its
    entries staged; the counts are kept per epoch below ``counters_path``
    (default: beside the checkpoint)."""
    stage_root = os.path.join(checkpoint, "stage")
    rejects = rejects_path or os.path.join(checkpoint, "rejected")
    counters = EpochLog(spark, counters_path or os.path.join(checkpoint, "counters"), COUNTERS, _added)
    size = F.coalesce(F.octet_length("line"), F.lit(0))

    names = [c.split()[0] for c in COUNTERS.split(", ")]
    passed = collect_passes(include, exclude)
    of_entries = {"entries": F.count("*"), "with_time": F.count_if("own_time"), "with_attributes": F.count_if(F.size("attributes") > 0),
                  "errors": F.count_if(F.col("severity") >= 5), "last_ts_ns": F.max("ts_ns")}

    def write_batch(batch: DataFrame, epoch: int) -> None:
        batch = with_arrival(batch) if "at" in batch.columns else batch
        batch = _spread(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counted = batch.agg(F.count("*").alias("lines"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
                                F.count_if(~passed).alias("gated"),
                                F.count_if(passed & (size > max_line_bytes)).alias("rejected")).first().asDict()
            if counted["rejected"]:
                batch.where(passed & (size > max_line_bytes)).write.mode("overwrite").parquet(f"{rejects}/epoch={epoch}")
            rows = _entries(batch.where(passed & (size <= max_line_bytes)))
            if since_ns is not None:
                rows = since(rows, since_ns)
            counted |= append_new(spark, rows, table_path, f"{stage_root}/epoch-{epoch}", postings_path=postings_path,
                                  counts=of_entries, also=["own_time"])
        finally:
            batch.unpersist()
        counters.write(spark.createDataFrame([tuple(counted[n] for n in names)], COUNTERS).coalesce(1), epoch)

    w = raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"processingTime": "5 seconds"}))
    return w.start()


def dedup_run(stream: DataFrame, out: str, checkpoint: str, order: str = "id", trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of log rows below ``out``, every content key once, first
    write wins; exact over any number of batches (``sinks.unique``)."""
    w = stream.writeStream.foreachBatch(rows_by_content(stream.sparkSession, out, order))
    return w.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def stream_dedup(stream: DataFrame, horizon: str = "15 minutes") -> DataFrame:
    """Cheap streaming dedup within an event-time horizon (opt-in: rows later
    than the watermark are dropped, which the exact path would store)."""
    return (stream.withColumn("ts", ns_to_ts("ts_ns")).withWatermark("ts", horizon)
            .dropDuplicatesWithinWatermark(DEDUP_KEY).drop("ts"))


def run_available(df: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Run a streaming frame over everything available now into files."""
    q = (df.writeStream.format(fmt).option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
