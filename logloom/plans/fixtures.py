"""The driver's tables seen as logs.

``events`` becomes a structured log table, the same rows rendered as raw
container lines in four shapes, a copy with re-delivered duplicates, and a
stream of container status snapshots; ``documents`` becomes a log table with
long multilingual messages for full-text search.  Every view is a plain
projection of a scan (no shuffle), so it grows with the tables.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions.severity import SEVERITY_LABELS
from logloom.functions.timestamps import floor_div, ntz_micros, utc_wallclock

# Fixed parameters of the views (documented in FIXTURES.md, part B).
NAMESPACES = ["web", "infra", "live", "trial", "meter"]
CONTAINERS = ["app", "agent", "edge"]
CLICK_TARGETS = ["basket", "filter", "profile"]
INGEST_NS = 1706745600000000000          # 2024-02-01T00:00:00Z, time of lines without prefix
DOC_BASE_NS = 1704067200000000000        # 2024-01-01T00:00:00Z
DUP_ID_OFFSET = 10_000_000
NEAR_DUP_ID_OFFSET = 20_000_000
NO_PREFIX_EVERY = 97
PLUS_TWO_EVERY = 6


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _event_severity() -> Column:
    et = F.col("event_type")
    return (F.when(et == "view", 1).when(et == "click", 2).when(et == "purchase", 3)
            .when(et == "signup", 4)
            .when(et == "error", F.when(F.col("value") > 100, 6).otherwise(5))
            .otherwise(0)).cast("int")


def _event_message() -> Column:
    et, eid = F.col("event_type"), F.col("event_id")
    return (F.when(et == "view", F.when(eid % 2 == 0, F.lit("cache warmed after restart"))
                   .otherwise(F.concat(F.lit("template built within "), (eid % 300).cast("string"), F.lit("ms"))))
            .when(et == "click", F.concat(F.lit("visitor opened the "), _pick(CLICK_TARGETS, eid % 3), F.lit(" panel")))
            .when(et == "purchase", F.concat(F.lit("payment settled within "), (eid % 500).cast("string"), F.lit("ms")))
            .when(et == "signup", F.concat(F.lit("quota nearly spent by account "),
                                           F.col("user_id").cast("string")))
            .when(et == "error", F.when(eid % 2 == 0, F.lit("cache write refused by shard"))
                  .otherwise(F.lit("ledger lost its cache lease")))
            .otherwise(et))


def events_ts_ns() -> Column:
    """``events.ts`` is a TIMESTAMP_NTZ read as UTC; microseconds are taken
    without any session time zone."""
    return ntz_micros("ts") * F.lit(1000) + F.col("event_id") % 1000


_CACHE: dict[str, list[Column]] = {}


def _cached(name: str, build) -> list[Column]:
    """Projection lists are unresolved expressions: build them once."""
    cols = _CACHE.get(name)
    if cols is None:
        cols = _CACHE[name] = build()
    return cols


def log_view(spark: SparkSession, sf_dir: str, spread_input: bool = False) -> DataFrame:
    """Structured log rows (schema of the log table, plus ``user_id`` and ``k``
    kept for the raw rendering).  ``spread_input`` spreads a small scan over
    the cores before the projection, for CPU-heavy consumers."""
    ev = read_table(spark, sf_dir, "events")
    if spread_input:
        ev = spread(ev)
    return ev.select(*_cached("log_view", _log_view_cols))


def _log_view_cols() -> list[Column]:
    k = F.get_json_object(F.col("props"), "$.k")
    return [
        (F.col("event_id") + 1).alias("id"),
        events_ts_ns().alias("ts_ns"),
        _pick(NAMESPACES, F.col("user_id") % 5).alias("namespace"),
        F.concat(F.col("event_type"), F.lit("-"), F.col("user_id").cast("string")).alias("pod"),
        _pick(CONTAINERS, F.col("event_id") % 3).alias("container"),
        _event_severity().alias("severity"),
        _event_message().alias("message"),
        F.map_filter(F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("k"), k),
                     lambda key, v: v.isNotNull()).alias("attributes"),
        F.col("event_id"), F.col("user_id"), F.col("value"), k.alias("k"),
    ]


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the log-table columns of :func:`log_view`."""
    return log_view(spark, sf_dir).select("id", "ts_ns", "namespace", "pod", "container",
                                          "severity", "message", "attributes")


def _rfc3339(ts_ns: Column, plus_two: Column) -> Column:
    secs = floor_div(ts_ns, 1_000_000_000)
    frac = F.lpad((ts_ns - secs * F.lit(1_000_000_000)).cast("string"), 9, "0")
    local = F.when(plus_two, secs + 7200).otherwise(secs)
    return F.concat(F.date_format(utc_wallclock(local * F.lit(1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), frac,
                    F.when(plus_two, F.lit("+02:00")).otherwise(F.lit("Z")))


def raw_view(spark: SparkSession, sf_dir: str, spread_input: bool = False) -> DataFrame:
    """The log rows rendered as raw container lines (RAW_SCHEMA + ingest_ns).

    Shape by ``event_id % 4``: 0 JSON, 1 logfmt, 2 ``[LEVEL] message``,
    3 plain message.  Every 97th line has no timestamp prefix; every 6th is
    written with a ``+02:00`` offset.
    """
    return log_view(spark, sf_dir, spread_input).select(*_cached("raw_view", _raw_view_cols))


def _raw_view_cols() -> list[Column]:
    eid, sev = F.col("event_id"), F.col("severity")
    label = _pick(SEVERITY_LABELS, sev)
    json_label = F.when(eid % 8 == 4, F.lower(label)).otherwise(label)
    lf_label = F.when(sev == 6, F.lit("panic")).otherwise(F.lower(label))
    br_label = F.when(sev == 4, F.lit("WARNING")).otherwise(label)
    uid = F.col("user_id").cast("string")
    body = (F.when(eid % 4 == 0, F.concat(
                F.lit('{"level":"'), json_label, F.lit('","msg":"'), F.col("message"),
                F.lit('","user_id":'), uid, F.lit(',"k":'), F.coalesce(F.col("k"), F.lit("null")),
                F.lit(',"value":'), F.col("value").cast("string"), F.lit("}")))
            .when(eid % 4 == 1, F.concat(
                F.lit("level="), lf_label, F.lit(' msg="'), F.col("message"), F.lit('" user_id='), uid,
                F.lit(" k="), F.coalesce(F.col("k"), F.lit(""))))
            .when(eid % 4 == 2, F.concat(F.lit("["), br_label, F.lit("] "), F.col("message")))
            .otherwise(F.col("message")))
    prefix = _rfc3339(F.col("ts_ns"), eid % PLUS_TWO_EVERY == PLUS_TWO_EVERY - 1)
    line = F.when(eid % NO_PREFIX_EVERY == NO_PREFIX_EVERY - 1, body).otherwise(F.concat(prefix, F.lit(" "), body))
    return [
        F.col("id").alias("arrival"), F.col("namespace"), F.col("pod"),
        F.concat(F.lit("uid-"), uid).alias("pod_uid"), F.col("container"),
        line.alias("line"), F.lit(INGEST_NS).alias("ingest_ns"),
    ]


def dup_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows plus re-deliveries: every 10th row again with a later id and
    severity 0 (must lose), every 25th with ts + 1 ns (a different row)."""
    base = logs_from_events(spark, sf_dir)
    redelivered = (base.where((F.col("id") - 1) % 10 == 0)
                   .withColumn("id", F.col("id") + DUP_ID_OFFSET).withColumn("severity", F.lit(0)))
    near = (base.where((F.col("id") - 1) % 25 == 0)
            .withColumn("id", F.col("id") + NEAR_DUP_ID_OFFSET).withColumn("ts_ns", F.col("ts_ns") + 1))
    return base.unionByName(redelivered).unionByName(near)


def doc_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as log rows: one message per document, one second apart."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        (F.col("doc_id") + 1).alias("id"),
        (F.lit(DOC_BASE_NS) + F.col("doc_id") * F.lit(1_000_000_000)).alias("ts_ns"),
        F.col("lang").alias("namespace"), F.col("source").alias("pod"), F.lit("main").alias("container"),
        F.lit(3).alias("severity"), F.col("text").alias("message"),
        F.lit(None).cast("map<string,string>").alias("attributes"),
    )


def status_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container status snapshots (STATUS_SCHEMA): one container per user,
    snapshots in ``event_id`` order; errors are 'not running'; a new
    container id every 5000 events; large signups delete the pod; pods
    are spread over three nodes."""
    ev = read_table(spark, sf_dir, "events")
    uid = F.col("user_id").cast("string")
    gen = floor_div(F.col("event_id"), 5000)
    return ev.select(
        _pick(NAMESPACES, F.col("user_id") % 5).alias("namespace"),
        F.concat(F.lit("pod-"), uid).alias("pod"),
        F.concat(F.lit("uid-"), uid).alias("pod_uid"),
        F.lit("main").alias("container"),
        F.col("event_id").alias("seq"),
        F.when((F.col("event_type") == "signup") & (F.col("value") > 200), F.lit("deleted"))
        .otherwise(F.lit("status")).alias("kind"),
        (F.col("event_type") != "error").alias("running"),
        gen.cast("int").alias("restart_count"),
        F.concat(uid, F.lit("-"), gen.cast("string")).alias("container_id"),
        F.concat(F.lit("node-"), (F.col("user_id") % 3).cast("string")).alias("node"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over as many tasks as shuffles have: the driver's tables come
    as one file with one row group."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
