"""Mixing sources to target weights, by DataFrame operations only.

Targets: a budget of words is shared among the sources by weight; a source's
target stops at ``max_epochs`` times its size, and what is above goes to the
others by weight until none is above.  In order of cap / weight the capped
sources come first, so the final level per unit of weight follows from
running sums over the source table.

Sample: within a source every document has the Efraimidis-Spirakis key
-ln(u) / quality with u from a hash of its id: the least keys are a weighted
sample without replacement.  A target of e whole epochs and a rest takes each
document e times, and the rest from documents in key order by a running sum
of their sizes; the document at the edge is taken in part.

The running sum never sorts a source in one task: the keys of a source are
cut into ``BUCKETS`` ranges of the key, sums per (source, range) give each
range its offset, and only ranges are sorted.  The ranges follow the qualities
that the documents have, so that low qualities (large keys) do not pile up in
the last one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.functions.bind import pinned

BLANK = "\\x20\\x09-\\x0D"
#: Ranges of sampling keys per source.  A range holds about a 4096th of all
#: documents, of one source or several, and the rows of a source in it are what
#: a task sorts.  Rows that share an id (or have none) and a quality share a
#: key, which no range divides.
BUCKETS = 4096
#: Classes of quality per power of two, and the powers that have their own.
QUALITY_STEPS = 8
QUALITY_POWERS = 32


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("bigint")


def text_quality(text: Column, size: Column) -> Column:
    """Words / (words + marks that prose has few of); 1 for an empty text."""
    marks = F.coalesce(F.regexp_count(text, F.lit("[|*#%&$!<>{}=+\\\\_^~@\\[\\]]")), F.lit(0))
    return F.when(size > 0, size / (size + marks)).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5,
                   max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target DOUBLE).

    Sources in order of code points, null last, weigh ``weights`` in turn.
    The table has one row per source.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    turns = F.array(*[F.lit(float(w)) for w in weights])
    cap = F.lit(max_epochs) * F.col("source_size")
    weighed = sizes.withColumn("weight", F.element_at(turns, (nth % len(weights) + 1).cast("int"))).withColumn(
        "cap", cap.cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    level = weighed.select(
        "*", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("below"),
        F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("budget"))
    # from the first source that stays under its cap on, all do: its level is the final one (they only fall)
    level = level.withColumn("level", (F.col("budget") - F.col("below")) / F.col("rest"))
    free = F.col("level") * F.col("weight") < F.col("cap")
    level = level.withColumn("final", F.max(F.when(free, F.col("level"))).over(everything))
    target = F.when(free, F.col("final") * F.col("weight")).otherwise(F.col("cap"))
    return level.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def with_ranges(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` for rows (key, quality): the range of the key, in key order;
    ``buckets`` for a null key.

    Keys of quality q exceed t with chance exp(-q t).  The mean of that over
    the classes of quality falls evenly from 1 to 0 over the documents.  It
    falls with t whatever the classes are, so ranges are always in key order;
    counts, least and largest qualities do not depend on the order of rows."""
    power = F.least(F.lit(QUALITY_POWERS), F.greatest(F.lit(-QUALITY_POWERS), F.log2("quality")))
    some = rows.select(pinned(F.col("quality")).alias("quality"))  # its expressions are costly and used often here
    classes = some.where((F.col("quality") > 0) & (F.col("quality") < float("inf"))).groupBy(
        F.floor(power * QUALITY_STEPS).alias("class")).agg(
        F.count("*").alias("n"), ((F.min("quality") + F.max("quality")) / 2).alias("rate"))
    mixture = classes.agg(F.sort_array(F.collect_list(F.struct("rate", "n"))).alias("rates"), F.sum("n").alias("total"))
    above = F.aggregate("rates", F.lit(0.0), lambda sum_, c: sum_ + c["n"] * F.exp(-c["rate"] * F.col("key")))
    part = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((1 - above / F.col("total")) * buckets)))
    bucket = F.when(F.col("key").isNull(), F.lit(buckets)).otherwise(F.coalesce(part, F.lit(0)))
    return rows.crossJoin(F.broadcast(mixture)).withColumn("bucket", bucket.cast("int")).drop("rates", "total")


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0,
        quality: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): one row per row of
    ``docs`` (doc_id, text, source).  ``taken``: the words the mix takes from
    the document, repeats counted; a source's sum is its target rounded down.

    Null texts have size 0 and are never taken; null sources are one source;
    rows alike in id, size and quality are interchangeable; reruns agree; an
    empty table gives an empty table.
    """
    text = F.col("text")
    size = word_count(text)
    u_bits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13),
                    16, 10).cast("double")
    u = (u_bits + 0.5) / F.lit(float(1 << 52))
    rows = docs.select("doc_id", "source", size.alias("size"),
                       (text_quality(text, size) if quality is None else quality).cast("double").alias("quality"),
                       u.alias("u"))
    usable = F.col("quality") > 0
    rows = rows.withColumn("key", F.when(usable, -F.log("u") / F.col("quality")))
    rows = with_ranges(rows, buckets).select("doc_id", "source", "size", "key", "bucket")
    by_range = rows.groupBy("source", "bucket").agg(F.sum("size").alias("range_size"))
    within = Window.partitionBy("source").orderBy("bucket")
    ranges = by_range.select("source", "bucket", (F.sum("range_size").over(within) - F.col("range_size")).alias("before"))
    sizes = by_range.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs).withColumnRenamed("source", "s")
    plan = ranges.join(targets, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target")
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "doc_id", "source", "size", "key", "bucket", "before", "source_size", "target")
    upto = Window.partitionBy("source", "bucket").orderBy(F.col("key").asc_nulls_last(), "doc_id", "size")
    start = F.col("before") + F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")
    return (placed.withColumn("start", start).withColumn("epochs", epochs.cast("bigint")).withColumn("rest", rest)
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("epochs") * F.col("size")
                     + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))).cast("bigint")
                    .alias("taken")))


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(len(regexp_extract_all(text, '[|*#%&$!<>{}=+\\_^~@\[\]]')), 0) AS marks,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln(u) / CASE WHEN size > 0 THEN size::DOUBLE / (size + marks)::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM rows),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3
              WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size,
         least(cap, CASE WHEN level * weight < cap
                         THEN max(CASE WHEN level * weight < cap THEN level END) OVER () * weight ELSE cap END) AS target
  FROM levels),
placed AS (
  SELECT k.doc_id, k.source, k.size, t.source_size, t.target,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS start,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - start)))::BIGINT AS taken
FROM placed
"""
