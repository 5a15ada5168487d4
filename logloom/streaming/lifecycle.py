"""Container lifecycle as a stateful stream.

A snapshot's event follows from the snapshot before it in ``seq`` order, so a
late snapshot changes its own event and that of its successor only.  The state
of a container holds its ``keep`` newest snapshots in order; a batch puts its
snapshots in and decides those anew and their successors, from the state alone:
nothing that was stored is read.  Decisions are a change log; the latest one
for a snapshot holds.  The state of a pod is forgotten some time after its
deletion, so state follows the containers that live.

A snapshot older than all that are kept cannot be decided: it is reported
(:func:`late_snapshots`), for a batch run of ``container_events`` over its
container.  Within one micro-batch the snapshots of a container are one task's
work, in bounded Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from logloom.schema import CONTAINER_KEY
from logloom.session import ship_package
from logloom.sinks.epochs import EpochLog

#: Snapshots of a container that are kept to place late ones.
KEEP = 256
#: How long a deleted pod is remembered.
FORGET_MS = 3_600_000
_STATE = "seqs array<bigint>, deleted array<boolean>, running array<boolean>, ids array<string>, cut boolean"
_KEYS = ", ".join(f"{k} string" for k in CONTAINER_KEY)
EVENTS = f"{_KEYS}, seq bigint, event string, late boolean"


def decide(before: tuple | None, now: tuple) -> str | None:
    """Event of a snapshot (deleted, running, container id) after another."""
    deleted, running, cid = now
    unseen = before is None or before[0]
    if deleted:
        return "STOP"
    if running and (unseen or before[1] is False or None not in (before[2], cid) and before[2] != cid):
        return "START"
    if running is False and not unseen and before[1]:
        return "STOP"
    return None


class History:
    """Snapshots of one container by ``seq``; with ``cut`` older ones than the
    first were let go."""

    def __init__(self, seqs=(), snaps=(), cut: bool = False):
        self.seqs, self.snaps, self.cut = list(seqs), list(snaps), cut

    def add(self, new: dict[int, tuple]) -> list[tuple[int, str | None, bool]]:
        """Put in the snapshots that are not there yet (the first one of a
        ``seq`` counts); (seq, event, late) of all that are decided by it."""
        out, fresh = [], []
        for seq in sorted(new):
            at = bisect_left(self.seqs, seq)
            if at < len(self.seqs) and self.seqs[at] == seq:
                continue
            if self.cut and at == 0:
                out.append((seq, None, True))
                continue
            fresh.append(seq)
        if fresh:
            merged = dict(zip(self.seqs, self.snaps)) | {s: new[s] for s in fresh}
            self.seqs = sorted(merged)
            self.snaps = [merged[s] for s in self.seqs]
            spots = {k for s in fresh for k in (bisect_left(self.seqs, s), bisect_left(self.seqs, s) + 1)}
            for k in sorted(s for s in spots if s < len(self.seqs)):
                out.append((self.seqs[k], decide(self.snaps[k - 1] if k else None, self.snaps[k]), False))
        return out

    def trim(self, keep: int) -> None:
        """The first of the snapshots that stay is never decided again."""
        if len(self.seqs) > keep + 1:
            self.cut = True
            self.seqs, self.snaps = self.seqs[-keep - 1:], self.snaps[-keep - 1:]


def _step(keep: int, forget_ms: int):
    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            seqs, *snaps, cut = state.get
            history = History(seqs, list(zip(*snaps)), cut)
        else:
            history = History()
        new = {}
        for rows in batches:
            # plain lists: a group has few rows, and a call of pandas costs more than they do
            for seq, kind, running, cid in zip(*(rows[c].tolist() for c in ("seq", "kind", "running", "container_id"))):
                snap = (kind == "deleted", None if running is None or running != running else bool(running),
                        None if cid is None or cid != cid else cid)
                new[seq] = min(new[seq], snap, key=repr) if seq in new else snap
        decided = history.add(new)
        history.trim(keep)
        state.update((history.seqs, *(list(c) for c in zip(*history.snaps)), history.cut))
        if history.snaps[-1][0]:
            state.setTimeoutDuration(forget_ms)
        if decided:
            seqs, events, late = zip(*decided)
            yield pd.DataFrame({**{n: [k] * len(seqs) for n, k in zip(CONTAINER_KEY, key)}, "seq": seqs,
                                "event": np.array(events, object), "late": late})
    return step


def container_events_stream(status_stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
                            keep: int = KEEP, forget_ms: int = FORGET_MS) -> StreamingQuery:
    """Status snapshot stream -> START/STOP events below ``root``.  Rows
    without ``seq`` are left out: they have no place."""
    spark = status_stream.sparkSession
    ship_package(spark)
    rows = status_stream.where("seq is not null").select(*CONTAINER_KEY, "seq", "kind", "running", "container_id")
    decided = rows.groupBy(*CONTAINER_KEY).applyInPandasWithState(
        _step(keep, forget_ms), EVENTS, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
    log = _log(spark, root)
    w = decided.writeStream.outputMode("update").foreachBatch(lambda batch, epoch: log.write(batch, epoch))
    w = w.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"}))
    # deleted pods are forgotten along with the next rows; a query with processing-time
    # timers would else run empty batches without end
    before = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, "false")
    try:
        return w.start()
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def _latest(log: DataFrame) -> DataFrame:
    held = log.groupBy(*CONTAINER_KEY, "seq").agg(F.max_by(F.struct("event", "late", "epoch"), "epoch").alias("last"))
    return held.select(*CONTAINER_KEY, "seq", "last.*")


def _log(spark: SparkSession, root: str) -> EpochLog:
    return EpochLog(spark, f"{root}/events", EVENTS, _latest)


def read_container_events(spark: SparkSession, root: str) -> DataFrame:
    """The events as decided by now: key, seq, event."""
    decided = _latest(_log(spark, root).read()).where(F.col("event").isNotNull() & ~F.col("late"))
    return decided.select(*CONTAINER_KEY, "seq", "event")


def late_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Key and seq of the snapshots that came too late to be decided."""
    return _latest(_log(spark, root).read()).where("late").select(*CONTAINER_KEY, "seq")
