"""Deduplication: first write wins on the content key.

The key is the five columns (ns time, namespace, pod, container, message);
severity and attributes are not part of it, so a re-delivered line keeps the
severity and attributes of its first arrival.  The winner is chosen with an
aggregate (``min_by`` on the arrival order), which combines map-side before
the shuffle: a key repeated in a third of all rows is reduced to one row per
map task before it moves, unlike a window that would pull it into one task.
The plan shows a sort-based partial and final aggregate (the buffer holds a
struct, which hash aggregation cannot keep): one shuffle of the rows, with
external sorting that spills instead of failing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.schema import DEDUP_KEY


def dedup_key(df: DataFrame) -> Column:
    """A 64-bit hash of the content key, for bucketing and quick checks only
    (equality is always decided on the five columns)."""
    return F.xxhash64(*[F.col(c) for c in DEDUP_KEY])


def dedup_first(df: DataFrame, order: str = "arrival", key: list[str] | None = None) -> DataFrame:
    """Keep, per key, the row with the smallest ``order`` value."""
    key = key or DEDUP_KEY
    rest = [c for c in df.columns if c not in key]
    winner = F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(order)).alias("__w")
    out = df.groupBy(*key).agg(winner)
    return out.select(*[F.col("__w." + c).alias(c) if c in rest else F.col(c) for c in df.columns])


def dedup_existing(df: DataFrame, key_present: Column | None = None) -> DataFrame:
    """Repair: among stored rows with the same key keep the smallest id.
    Rows whose key is not set (``key_present`` false, legacy rows) are left
    untouched."""
    if key_present is None:
        return dedup_first(df, order="id")
    keyed = df.where(key_present)
    legacy = df.where(~key_present | key_present.isNull())
    return dedup_first(keyed, order="id").unionByName(legacy)


def backfill_key(df: DataFrame, key_col: str = "dedup_key") -> DataFrame:
    """Give every row without a key its key (the key is derived, so this is
    a projection; as a job it rewrites the partitions lacking the column)."""
    return df.withColumn(key_col, F.coalesce(F.col(key_col), dedup_key(df)))
