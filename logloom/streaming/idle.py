"""Idle containers: no line for longer than a timeout.

:func:`idle_events_stream` reports each time a container goes idle, with
event-time timers: a line sets its container's timer, a later line within the
timeout cancels it, and when the watermark passes a deadline the idle event is
written.  A container has state only while a timer of its runs; containers
share state rows by hash (:data:`BUCKETS`), so a batch costs as its rows and
running timers do, not a call for each container.

:func:`last_lines_stream` keeps the newest line time of every container, for
asking which are idle at a given time; a maximum, so neither the order of rows
nor how they fall into batches matters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from logloom.functions.timestamps import ns_to_ts
from logloom.operators.lifecycle import idle_containers
from logloom.session import ship_package
from logloom.sinks.epochs import EpochLog

IDLE_KEY = ["namespace", "pod", "container"]
TIMEOUT_NS = 5 * 60 * 1_000_000_000
#: Groups that containers are dealt to by hash: each has one state row.
BUCKETS = 256
_KEYS = ", ".join(f"{k} string" for k in IDLE_KEY)
_TIMERS = ", ".join(f"{k} array<string>" for k in IDLE_KEY) + ", ts_ns array<bigint>"
IDLE_EVENTS = f"{_KEYS}, last_ts_ns bigint, idle_ns bigint"
_LAST = f"{_KEYS}, ts_ns bigint"


def _last_of_runs(codes: np.ndarray, times: np.ndarray, timeout_ns: int) -> np.ndarray:
    """Of lines in order of container and time: which no later line of their
    container follows in time (of equal ones the last)."""
    followed = (codes[1:] == codes[:-1]) & (times[1:] - times[:-1] <= timeout_ns)
    return np.append(~followed, len(times) > 0)[:len(times)]


def open_timers(times: list[int], timeout_ns: int) -> list[int]:
    """Of line times in order, those that no later line follows in time."""
    at = np.array(times, np.int64)
    return at[_last_of_runs(np.zeros(len(at)), at, timeout_ns)].tolist()


def _step(timeout_ns: int):
    whole, part = divmod(timeout_ns, 1_000_000)

    def deadlines(t: np.ndarray) -> np.ndarray:  # in ms, as watermarks are
        return t // 1_000_000 + whole - (-(t % 1_000_000 + part) // 1_000_000)

    def step(_, batches, state):
        held = dict(zip([*IDLE_KEY, "ts_ns"], state.get)) if state.exists else {}
        parts = [pd.DataFrame(held, dtype=object)] if held else []
        rows = pd.concat([*parts, *(b[[*IDLE_KEY, "ts_ns"]] for b in batches)], ignore_index=True)  # no batch when a timer fired
        codes, times = rows.groupby(IDLE_KEY, dropna=False, sort=False).ngroup().to_numpy(), rows["ts_ns"].to_numpy(np.int64)
        order = np.lexsort((times, codes))
        order = order[_last_of_runs(codes[order], times[order], timeout_ns)]
        now, due = state.getCurrentWatermarkMs(), deadlines(times[order])
        # no line at or before the watermark comes any more: passed deadlines hold
        left, idle = rows.iloc[order[due >= now]], rows.iloc[order[due < now]]
        if len(left):
            state.update(tuple(left[c].tolist() for c in [*IDLE_KEY, "ts_ns"]))
            state.setTimeoutTimestamp(int(due[due >= now].min()))
        elif state.exists:
            state.remove()
        if len(idle):
            last = idle["ts_ns"].astype("int64")
            yield idle[IDLE_KEY].assign(last_ts_ns=last, idle_ns=last + timeout_ns)
    return step


def idle_events_stream(logs: DataFrame, out: str, checkpoint: str, timeout_ns: int = TIMEOUT_NS, lateness: str = "1 minute",
                       trigger: dict | None = None) -> StreamingQuery:
    """Log-row stream (ts_ns) -> one row below ``out`` each time a container
    had no line for ``timeout_ns``: the last line's time and when the timeout
    passed.  Lines may come out of order by ``lateness``; a row that is later
    than that counts as dropped in the query's progress."""
    spark = logs.sparkSession
    ship_package(spark)
    bucket = F.pmod(F.xxhash64(*IDLE_KEY), F.lit(BUCKETS)).alias("bucket")
    rows = logs.select(*IDLE_KEY, "ts_ns", ns_to_ts("ts_ns").alias("ts"), bucket).withWatermark("ts", lateness)
    events = rows.groupBy("bucket").applyInPandasWithState(
        _step(timeout_ns), IDLE_EVENTS, _TIMERS, "append", GroupStateTimeout.EventTimeTimeout)
    log = EpochLog(spark, out, IDLE_EVENTS)
    w = events.writeStream.outputMode("append").foreachBatch(lambda batch, epoch: log.write(batch, epoch))
    return w.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def read_idle_events(spark: SparkSession, out: str) -> DataFrame:
    return EpochLog(spark, out, IDLE_EVENTS).read().drop("epoch")


def _newest(log: DataFrame) -> DataFrame:
    return log.groupBy(*IDLE_KEY).agg(F.max("ts_ns").alias("ts_ns"), F.max("epoch").alias("epoch"))


def last_lines_stream(logs: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Log-row stream -> newest line time per container below ``out``."""
    log = EpochLog(logs.sparkSession, out, _LAST, _newest)
    newest = logs.groupBy(*IDLE_KEY).agg(F.max("ts_ns").alias("ts_ns"))
    w = newest.writeStream.outputMode("update").foreachBatch(lambda batch, epoch: log.write(batch, epoch))
    return w.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def idle_now(spark: SparkSession, out: str, now_ns: int, timeout_ns: int) -> DataFrame:
    """Containers whose last line is older than ``timeout_ns`` at ``now_ns``."""
    rows = EpochLog(spark, out, _LAST).read().drop("epoch")
    return idle_containers(rows, now_ns, timeout_ns, key=tuple(IDLE_KEY))
