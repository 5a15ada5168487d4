"""A file sink in which every key occurs once, over any number of
micro-batches in any order.

A batch is made unique by itself, then compared with what the sink holds in
the same slots (a coarse partition of the key: a day, an id range) and
between the batch's bounds there, so its cost follows the batch and not the
sink.  Rows are written under their query and epoch: a replayed batch replaces
what it wrote before, and only that.

``MERGE`` epochs of a slot are written as one folder, and as many of these as
one again, so a batch opens few files however long the query runs and a row is
rewritten a few times.  A query merges what it alone wrote; where several write
one sink, run :func:`merge_unique` while none of them does.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions.timestamps import floor_div, ns_to_date
from logloom.operators.dedup import dedup_first
from logloom.schema import DEDUP_KEY
from logloom.sinks import fs, swap
from logloom.sinks.epochs import query_id

SLOT, EPOCH = "slot", "epoch"
#: Ids per slot of a sink keyed by id.
IDS_PER_SLOT = 1 << 20
#: Groups of neighbouring slots that each get bounds of their own in the
#: pushed filter.
MAX_BOUNDS = 64
#: Folders of one level in a slot from which they become one of the next.
MERGE = 64
_STAGE = "_merging"


def near(slots: list, slot: Column, bound: Column) -> Column:
    """Filter on stored rows: the slots (value, low, high) of a batch, one row
    each, as partition and row-group predicates.  Many slots are bounded in
    groups of neighbours, so the bounds widen step by step."""
    slots = sorted(slots, key=lambda s: (s[0] is None, s[0]))
    size = -(-len(slots) // MAX_BOUNDS)
    cond = F.lit(False)
    for k in range(0, len(slots), size or 1):
        some = slots[k:k + size]
        cond = cond | (slot.isin([s[0] for s in some]) & bound.between(min(s[1] for s in some), max(s[2] for s in some)))
    if len(slots) > 1:  # what all of them have in common reaches the scan as plain ranges
        cond = cond & slot.isin([s[0] for s in slots]) & bound.between(min(s[1] for s in slots), max(s[2] for s in slots))
    return cond


def unique_sink(spark: SparkSession, path: str, key: list[str], slot: Column, bound: str,
                order: str | None = None, merge: int = MERGE) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function.  ``slot`` must follow from ``key``; ``order``:
    which of equal keys in a batch stays (the least).  Epochs are named after
    the streaming query (its checkpoint) as well, so several queries may write
    one sink.  ``merge``: see :func:`merge_unique`."""
    alone = f"batch{uuid.uuid4().hex[:8]}"

    def sink(batch: DataFrame, epoch: int) -> None:
        writer = query_id(spark) or alone
        name = f"{writer}-{epoch}"
        swap.resume(spark, path, f"{path}/{_STAGE}")
        rows = dedup_first(batch, order=order, key=key) if order else batch.dropDuplicates(key)
        rows = rows.withColumn(SLOT, slot).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            slots = [tuple(r) for r in rows.groupBy(SLOT).agg(F.min(bound), F.max(bound)).collect()]
            if not slots:
                return
            fresh = rows
            if fs.exists(spark, path):
                stored = spark.read.parquet(path).where((F.col(EPOCH) != name) & near(slots, F.col(SLOT), F.col(bound)))
                fresh = rows.join(stored.select(*key, SLOT), [*key, SLOT], "left_anti")
            # ranges of (slot, bound): few files per slot, narrow bounds, a hot slot over many writers
            fresh = fresh.repartitionByRange(SLOT, bound).sortWithinPartitions(SLOT, bound)
            (fresh.withColumn(EPOCH, F.lit(name)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(SLOT, EPOCH).parquet(path))
        finally:
            rows.unpersist()
        if epoch % merge == merge - 1:
            merge_unique(spark, path, bound, merge, only=writer)
    return sink


def _folders(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(slot folder, epoch folder, its path) of a sink."""
    return [(slot, name, full) for slot, at in fs.list_dirs(spark, path) if slot.startswith(f"{SLOT}=")
            for name, full in fs.list_dirs(spark, at) if name.startswith(f"{EPOCH}=")]


def _level(name: str) -> int:
    """Of an epoch folder: 0, or how often its rows were merged."""
    found = re.fullmatch(rf"{EPOCH}=m(\d+)-[0-9a-f]{{8}}", name)
    return int(found[1]) if found else 0


def merge_unique(spark: SparkSession, path: str, bound: str, merge: int = MERGE, only: str | None = None) -> int:
    """Write the epoch folders of every slot that has ``merge`` or more of one
    level as one folder of the next level; the number of folders taken in.
    One that dies is finished by the next batch or merge.  ``only``: do nothing
    where another query than this one has epochs that are not merged."""
    stage_root, taken, level = f"{path}/{_STAGE}", 0, 0
    swap.resume(spark, path, stage_root)
    while True:
        folders = _folders(spark, path)
        if only and any(_level(name) == 0 and not name.startswith(f"{EPOCH}={only}-") for _, name, _ in folders):
            return taken
        here = [f for f in folders if _level(f[1]) == level]
        many = {slot for slot, n in Counter(slot for slot, _, _ in here).items() if n >= merge}
        here = [full for slot, _, full in here if slot in many]
        if not here and level >= max((_level(name) for _, name, _ in folders), default=0):
            return taken
        level += 1
        if here:
            _merge(spark, path, here, bound, level, stage_root)
            taken += len(here)


def _merge(spark: SparkSession, path: str, folders: list[str], bound: str, level: int, stage_root: str) -> None:
    files = [f for folder in folders for n, f in fs.list_dirs(spark, folder) if n.endswith(".parquet") and n[0] not in "._"]
    if files:
        stage, name = f"{stage_root}/{swap.stage_name(path, 'epochs')}", f"m{level}-{uuid.uuid4().hex[:8]}"
        rows = spark.read.option("basePath", path).parquet(*files).drop(EPOCH)
        rows = rows.repartitionByRange(SLOT, bound).sortWithinPartitions(SLOT, bound)
        steps = swap.replacement_by(spark, rows, SLOT, path, files, f"{stage}/rows", name, f"/{EPOCH}={name}")
        swap.commit(spark, stage, steps, len(files))
    for folder in folders:  # empty now; one left behind is taken in by the next merge of its level
        fs.delete(spark, folder)


def rows_by_id(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """Each id once (a viewer's rows)."""
    return unique_sink(spark, path, ["id"], floor_div(F.col("id"), IDS_PER_SLOT), "id")


def rows_by_content(spark: SparkSession, path: str, order: str = "id") -> Callable[[DataFrame, int], None]:
    """Each content key once, the first write wins."""
    return unique_sink(spark, path, DEDUP_KEY, ns_to_date("ts_ns"), "ts_ns", order)


def read_unique(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(SLOT, EPOCH)
