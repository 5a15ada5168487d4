"""Live tail over the log table.

The table directory is read as a file stream: each new file is a new batch,
filtered with the same conditions as a query (end time excluded); the sink
is any streaming sink.  Viewers show each id once and keep the newest 1000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions.timestamps import ns_to_ts
from logloom.operators.query import LogQuery, apply_query
from logloom.sinks import fs
from logloom.sinks.unique import rows_by_id
from logloom.sources.logs import TABLE_SCHEMA

VIEW_SIZE = 1000


def tail_source(spark: SparkSession, table_path: str, max_files: int = 1000) -> DataFrame:
    """The table's files as a stream.  A file that retention takes away
    before it was read is skipped: the rows it keeps come again in the
    rewritten day, which the stream meets as new files, and
    :func:`tail_run` shows every id once."""
    return (spark.readStream.schema(TABLE_SCHEMA).option("maxFilesPerTrigger", max_files)
            .option("ignoreMissingFiles", "true").parquet(table_path))


def tail_stream(spark: SparkSession, table_path: str, q: LogQuery, last_id: int | None = None) -> DataFrame:
    """Rows matching ``q`` (no end time) as a stream; from ``last_id`` on."""
    src = tail_source(spark, table_path)
    out = apply_query(src, q.with_(end_ns=None, after_id=last_id or q.after_id, before_id=None))
    return out


def tail_run(rows: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a tail (or overlapping polls of one) below ``out``, every id
    once, whatever order its files come in and whatever retention rewrites;
    read it with ``sinks.unique.read_unique``."""
    w = rows.writeStream.foreachBatch(rows_by_id(rows.sparkSession, out)).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "1 second"})).start()


def tail_resume(df: DataFrame, last_id: int, q: LogQuery | None = None, limit: int = 100) -> DataFrame:
    """Batch form of a reconnect: the next ``limit`` rows after ``last_id``, ascending."""
    q = (q or LogQuery()).with_(end_ns=None, after_id=last_id, before_id=None, order="asc")
    return apply_query(df, q).orderBy("id").limit(limit)


def tail_open(df: DataFrame, params: dict, initial: int = 50, batch: int = 100) -> DataFrame:
    """What a viewer receives on connecting: the newest ``initial`` matching
    rows oldest first, or, when it reconnects with ``lastId``, the next
    ``batch`` rows after it."""
    from logloom.operators.paging import tail_initial

    q, last_id = LogQuery.from_tail_params(params)
    if last_id:
        return tail_resume(df, last_id, q, limit=batch)
    return tail_initial(df, q, n=initial)


def tail_dedup(stream: DataFrame, horizon: str = "15 minutes") -> DataFrame:
    """Each id once within an event-time horizon (opt-in: rows later than the
    watermark are dropped; :func:`tail_run` keeps all)."""
    return (stream.withColumn("__ts", ns_to_ts("ts_ns")).withWatermark("__ts", horizon)
            .dropDuplicatesWithinWatermark(["id"]).drop("__ts"))


def tail_window_sink(spark: SparkSession, view_dir: str, n: int = VIEW_SIZE):
    """foreachBatch function keeping the newest ``n`` rows under ``view_dir``.
    Two folders alternate by epoch parity, so a batch never overwrites the
    files it reads; a replayed epoch rewrites the same folder."""
    def sink(batch: DataFrame, epoch: int) -> None:
        cur = f"{view_dir}/v{epoch % 2}"
        prev = f"{view_dir}/v{(epoch + 1) % 2}"
        rows = batch
        if fs.exists(spark, prev + "/_SUCCESS"):
            rows = spark.read.parquet(prev).unionByName(batch)
        rows.orderBy(F.col("id").desc()).limit(n).write.mode("overwrite").parquet(cur)
    return sink


def read_window(spark: SparkSession, view_dir: str, n: int = VIEW_SIZE) -> DataFrame:
    """The current view: newest ``n`` of both folders (the older folder only
    holds rows the newer one has or has pushed out)."""
    parts = [spark.read.parquet(f"{view_dir}/v{i}") for i in (0, 1) if fs.exists(spark, f"{view_dir}/v{i}/_SUCCESS")]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.dropDuplicates(["id"]).orderBy(F.col("id").desc()).limit(n)
