"""Previous row per key, safe for hot keys.

``lag`` over a window partitioned by key sends every row of a key to one
task; if one key holds a third of all rows, that task holds a third of the
data.  Here a key is split into ordered buckets of the order column: the
window runs per (key, bucket), and the first row of each bucket takes the
last row of the previous non-empty bucket of its key, found on a per-bucket
summary (one row per bucket, built with a map-side-combined aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from logloom.functions.timestamps import floor_div


def previous_by_key(df: DataFrame, key: list[str], order: str, cols: list[str],
                    bucket_width: int, out: str = "prev") -> DataFrame:
    """Add struct column ``out`` holding ``cols`` of the previous row of the
    same key in ``order`` (NULL for the first row of a key)."""
    b = "__bucket"
    data = df.withColumn(b, floor_div(F.col(order), bucket_width))
    row = F.struct(*[F.col(c) for c in cols])
    w = Window.partitionBy(*key, b).orderBy(order)
    data = data.withColumn("__prev_in", F.lag(row).over(w))
    last = data.groupBy(*key, b).agg(F.max_by(row, F.col(order)).alias("__last"))
    wb = Window.partitionBy(*key).orderBy(b)
    carry = last.withColumn("__carry", F.lag("__last").over(wb)).drop("__last")
    joined = data.join(carry, on=[*key, b], how="left")
    return joined.withColumn(out, F.coalesce(F.col("__prev_in"), F.col("__carry"))).drop("__prev_in", "__carry", b)
