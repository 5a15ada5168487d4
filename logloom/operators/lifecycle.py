"""Container lifecycle from status snapshots: START / STOP events.

Per container key (namespace, pod, pod uid, container), snapshots in ``seq``
order.  A running snapshot starts the container when the key is unseen,
was not running, or runs a different container id; a not-running snapshot
stops it when it was running; a pod deletion stops every container (even a
stopped one) and forgets the key.  The decision only needs the previous
snapshot of the key, found with the hot-key-safe :func:`previous_by_key`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logloom.operators.skew import previous_by_key
from logloom.schema import CONTAINER_KEY

# Width of the seq buckets that split one container's history across tasks.
DEFAULT_BUCKET = 1 << 20


def container_events(status: DataFrame, bucket_width: int = DEFAULT_BUCKET, node: str | None = None) -> DataFrame:
    """Snapshots -> events (key, seq, event); snapshots without event dropped."""
    return snapshot_events(status, bucket_width, node).where(F.col("event").isNotNull())


def snapshot_events(status: DataFrame, bucket_width: int = DEFAULT_BUCKET, node: str | None = None) -> DataFrame:
    """Every snapshot with its event, NULL where it gives none."""
    if node is not None and "node" in status.columns:
        status = status.where(F.col("node") == node)
    with_prev = previous_by_key(status, CONTAINER_KEY, "seq", ["kind", "running", "container_id"], bucket_width)
    p = F.col("prev")
    unseen = p.isNull() | (p["kind"] == "deleted")
    running = F.col("running")
    event = (F.when(F.col("kind") == "deleted", F.lit("STOP"))
             .when(running & (unseen | ~p["running"] | (p["container_id"] != F.col("container_id"))), F.lit("START"))
             .when(~running & ~unseen & p["running"], F.lit("STOP")))
    return with_prev.select(*CONTAINER_KEY, "seq", "restart_count", event.alias("event"))


def container_restarts(status: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Per key: highest restart count seen, and STARTs after the first."""
    events = events if events is not None else container_events(status)
    starts = events.groupBy(*CONTAINER_KEY).agg(
        F.sum(F.when(F.col("event") == "START", 1).otherwise(0)).cast("long").alias("starts"))
    maxrc = status.groupBy(*CONTAINER_KEY).agg(F.max("restart_count").alias("max_restart_count"))
    return maxrc.join(starts, CONTAINER_KEY, "left").select(
        *CONTAINER_KEY, "max_restart_count",
        F.greatest(F.coalesce(F.col("starts"), F.lit(0)) - 1, F.lit(0)).cast("long").alias("restarts"))


def active_containers(events: DataFrame) -> DataFrame:
    """Keys whose last event is START (the running streams)."""
    last = events.groupBy(*CONTAINER_KEY).agg(F.max_by("event", "seq").alias("last_event"))
    return last.where(F.col("last_event") == "START").select(*CONTAINER_KEY)


def idle_containers(logs: DataFrame, now_ns: int, timeout_ns: int = 5 * 60 * 1_000_000_000,
                    key=("namespace", "pod", "container")) -> DataFrame:
    """Containers with no line for longer than ``timeout_ns`` before ``now_ns``."""
    last = logs.groupBy(*key).agg(F.max("ts_ns").alias("last_ts_ns"))
    return last.where(F.col("last_ts_ns") < F.lit(now_ns - timeout_ns))


def resume_cursors(logs: DataFrame, key=("namespace", "pod", "container")) -> DataFrame:
    """Per container the time to resume reading from: last line time + 1 ns."""
    return logs.groupBy(*key).agg((F.max("ts_ns") + 1).alias("resume_ns"))
