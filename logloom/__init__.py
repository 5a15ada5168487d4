"""logloom: a Spark-native container-log engine.

Raw or structured log lines are parsed with built-in column expressions,
deduplicated first-write-wins, stored as a date-partitioned Parquet log
table and searched by time, namespace, pod, container, severity,
attributes and stemmed full text, in batch or with Structured Streaming.
"""

from logloom.schema import LOG_SCHEMA, RAW_SCHEMA, STATUS_SCHEMA, Severity  # noqa: F401
from logloom.session import get_session, checkpoint_root  # noqa: F401
