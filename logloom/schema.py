"""Fixed schemas of the log engine (never inferred)."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T


class Severity(IntEnum):
    """Ordered severity enum; 0 means unknown."""

    UNKNOWN = 0
    TRACE = 1
    DEBUG = 2
    INFO = 3
    WARN = 4
    ERROR = 5
    FATAL = 6


# Stored log table. ``ts_ns`` is Unix nanoseconds (Spark timestamps stop at
# microseconds); ``log_date`` is the UTC day of ``ts_ns`` and the partition
# column; ``terms`` is the stemmed token array used by full-text search.
LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts_ns", T.LongType(), False),
    T.StructField("namespace", T.StringType(), False),
    T.StructField("pod", T.StringType(), False),
    T.StructField("container", T.StringType(), False),
    T.StructField("severity", T.IntegerType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType()), True),
])

LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields]

# One raw container line with the container it came from; ``arrival`` is the
# order in which the line was received (file offset, Kafka offset, ...).
RAW_SCHEMA = T.StructType([
    T.StructField("arrival", T.LongType(), False),
    T.StructField("namespace", T.StringType(), False),
    T.StructField("pod", T.StringType(), False),
    T.StructField("pod_uid", T.StringType(), False),
    T.StructField("container", T.StringType(), False),
    T.StructField("line", T.StringType(), False),
])

# One container status snapshot (or a pod deletion) as seen by discovery.
STATUS_SCHEMA = T.StructType([
    T.StructField("namespace", T.StringType(), False),
    T.StructField("pod", T.StringType(), False),
    T.StructField("pod_uid", T.StringType(), False),
    T.StructField("container", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("running", T.BooleanType(), False),
    T.StructField("restart_count", T.IntegerType(), False),
    T.StructField("container_id", T.StringType(), False),
])

CONTAINER_KEY = ["namespace", "pod", "pod_uid", "container"]

# The content key of first-write-wins deduplication: severity and attributes
# are deliberately not part of it.
DEDUP_KEY = ["ts_ns", "namespace", "pod", "container", "message"]
