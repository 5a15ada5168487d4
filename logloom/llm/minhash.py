"""MinHash document fingerprints.

A text's distinct word shingles (five words between ASCII blanks, ASCII lower
case; fewer words: the whole sequence) are hashed to 64 bits.  Each of
``PERMUTATIONS`` universal hash functions x -> a x + b (a odd, modulo 2^64)
orders them, and the fingerprint keeps 16 bits of each function's least
value.  The share of equal slots estimates the Jaccard similarity.

``similar_pairs`` finds near duplicates: bands of slots are joined in Spark
and candidates verified by the exact Jaccard similarity of their shingles.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.common import LOWER, arrow_map, cut, slices
from logloom.llm.components import connected_components
from logloom.llm.features import lay_out, mix
from logloom.session import ship_package

PERMUTATIONS = 128
SHINGLE = 5
#: Shingles that are permuted at once.
_BLOCK = 512
#: ASCII lower case; only 0x20 and 0x09-0x0D end a word.
_WORDS = bytes(32 if 9 <= c <= 13 else LOWER[c] for c in range(256))


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(2024))
    return (rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1),
            rng.integers(0, 1 << 63, n, np.uint64))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of the word shingles of each text."""
    laid = lay_out(texts, _WORDS)
    words, at = laid.word_hashes, laid.word_range
    run = np.zeros(max(0, len(words) - shingle + 1), np.uint64)
    for k in range(shingle):
        run = run * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(run)]
    run = mix(run)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= shingle:
            out.append(run[a:b - shingle + 1])
        elif b > a:
            whole = b - a
            for w in words[a:b].tolist():
                whole = (whole * 0x9E3779B97F4A7C15 + w) % (1 << 64)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(run[:0])
    return out


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """(texts x permutations) of 16-bit slots; an empty set has only zeros."""
    a, b = _functions(permutations)
    out = np.zeros((len(sets), permutations), np.uint64)
    for i, hashes in enumerate(sets):
        if len(hashes):
            least = None
            for at in range(0, len(hashes), _BLOCK):
                part = hashes[at:at + _BLOCK]
                values = (np.multiply.outer(a, part) + b[:, None]).min(axis=1)
                least = values if least is None else np.minimum(least, values)
            out[i] = least
    return (mix(out) >> np.uint64(48)).astype(np.uint16) * (np.array([len(s) for s in sets]) > 0)[:, None].astype(np.uint16)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal slots, row by row."""
    return (x == y).mean(axis=1)


def as_text(slots: np.ndarray) -> list[str]:
    """Four hex digits per slot."""
    big = slots.astype(">u2")
    return [row.tobytes().hex() for row in big]


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint BINARY: big-endian 16-bit slots) per row; null and
    blank texts have only zeros."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots = signatures(shingle_sets(batch.column(1), shingle), permutations).astype(">u2")
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in slots], pa.binary())],
                                          ["doc_id", "fingerprint"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run,
                     "doc_id bigint, fingerprint binary")


# ----------------------------------------------------- text and next text

def beside_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows (doc_id, text, tag) in partitions sorted by descending doc_id
    (nulls last, ties by text), each followed by the row that comes next in
    the whole table; such a last row of a partition has tag 1 and is there
    only to be looked at.  After the table's last row comes its first.

    Split points are quantiles of doc_id, so the texts are shuffled once and
    never sorted in one task.
    """
    spark = docs.sparkSession
    partitions = min(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), 2000)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shares = [i / partitions for i in range(1, partitions)] or [0.5]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, 100 * max(100, partitions))).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)  # fewer than ``partitions`` numbers
    # partition 0 holds the largest ids, the last one the nulls
    at_least = [F.when(F.col("doc_id") >= c, F.lit(k)) for k, c in enumerate(cuts)]
    rows = rows.withColumn("part", F.coalesce(*at_least, F.lit(len(cuts))))
    # the first id of each filled partition is what the partition before looks at; the first one's, the last
    rank = F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("top"))
    first = {r.part: r.m.top for r in rows.groupBy("part").agg(F.max(rank).alias("m")).toLocalIterator()}
    filled = sorted(first)
    before = {part: filled[k - 1] for k, part in enumerate(filled)}
    numbers = range(len(cuts) + 1)
    tops = F.array(*[F.lit(first.get(k)).cast("bigint") for k in numbers])
    looks = F.array(*[F.lit(before.get(k)).cast("int") for k in numbers])
    shown = F.when(F.col("doc_id").eqNullSafe(F.element_at(tops, F.col("part") + 1)),
                   F.struct(F.element_at(looks, F.col("part") + 1).alias("part"), F.lit(1).alias("tag")))
    both = F.array_compact(F.array(F.struct(F.col("part"), F.lit(0).alias("tag")), shown))
    dealt = rows.select("doc_id", "text", F.inline(both))
    return (dealt.repartitionById(len(cuts) + 1, "part")
            .sortWithinPartitions("tag", F.col("doc_id").desc_nulls_last(), "text")
            .select("doc_id", "text", "tag"))


def with_edited(docs: DataFrame, permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint STRING,
    near_edited, near_next DOUBLE).  The edited text has the last
    floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next text by descending doc_id; after the last comes the first.  Null
    texts are empty; equal ids follow each other by text, null ids come last.
    """
    import hashlib

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(ids, texts, slots, nexts, next_slots):
        edited = []
        for text, other in zip(texts, nexts):
            cut_ = len(text) // 3
            edited.append(text[:len(text) - cut_] + other[:cut_])
        own = signatures(shingle_sets(pa.array(edited, pa.string()), shingle), permutations)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(as_text(slots), pa.string()), pa.array(as_text(own), pa.string()),
            pa.array(likeness(slots, own)), pa.array(likeness(slots, next_slots))], names)

    def run(batches):
        last = None  # (id, text, slots) of a row whose next row is not seen yet
        closed = False
        for batch in batches:
            for part in slices(batch):
                if part.num_rows == 0 or closed:
                    continue
                ids, texts, tags = (part.column(k).to_pylist() for k in range(3))
                looked = tags.index(1) if 1 in tags else None
                if looked is not None:  # only the first such row comes next
                    ids, texts = ids[:looked + 1], texts[:looked + 1]
                    closed = True
                slots = signatures(shingle_sets(pa.array(texts, pa.string()), shingle), permutations)
                if last is not None:
                    ids, texts = [last[0], *ids], [last[1], *texts]
                    slots = np.concatenate([last[2], slots])
                if len(ids) > 1:
                    yield emit(ids[:-1], texts[:-1], slots[:-1], texts[1:], slots[1:])
                last = (ids[-1], texts[-1], slots[-1:])

    ship_package(docs.sparkSession)
    return beside_next(docs).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


# ------------------------------------------------------------ near copies

def band_edges(fingerprint: Column, bands: int, rows: int) -> Column:
    """One (band, key) struct per band of ``rows`` slots."""
    return F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(F.substring(fingerprint, 1 + 2 * rows * k, 2 * rows))
                              .alias("key")) for k in range(bands)])


def similar_pairs(docs: DataFrame, threshold: float = 0.8, shingle: int = SHINGLE, bands: int = 32,
                  rows: int = 4) -> DataFrame:
    """(a, b, jaccard): pairs of different shingle sets with a Jaccard
    similarity of ``threshold`` or more, each as the smallest doc_id with
    that set.

    With 32 bands of 4 slots a pair at 0.8 is missed with a chance of 5e-8.
    A band shared by many is joined like any other, its hot partition split.
    """
    sets, links = _similar(docs, threshold, shingle, bands, rows)
    rep = sets.groupBy("node").agg(F.min("doc_id").alias("rep"))
    return links.join(rep.toDF("x", "ra"), "x").join(rep.toDF("y", "rb"), "y").select(
        F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "jaccard")


def classes(docs: DataFrame, threshold: float = 0.8, shingle: int = SHINGLE, bands: int = 32,
            rows: int = 4) -> DataFrame:
    """(doc_id, class_id, links) per row: class_id is the smallest doc_id in
    the component of near copies, links the number of other shingle sets the
    row's own is linked to.  Null ids never name a class that has another;
    texts without words are one set, linked to no other."""
    sets, links = _similar(docs, threshold, shingle, bands, rows)
    comps = connected_components(links, "x", "y")
    degree = links.select("x").unionAll(links.select("y")).groupBy("x").count().toDF("node", "links")
    nodes = sets.groupBy("node").agg(F.min("doc_id").alias("rep")).join(comps, "node", "left").join(
        degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    top = nodes.groupBy("component").agg(F.min("rep").alias("class_id"))
    of = nodes.join(top, "component").select("node", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return sets.select("doc_id", "node").join(of, "node").select("doc_id", "class_id", "links")


def _similar(docs: DataFrame, threshold: float, shingle: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, ...) per row, node naming the shingle set; (x, y, jaccard) of nodes."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(s) for s in shingle_sets(batch.column(1), shingle)]
        slots = signatures(sets, bands * rows).astype(">u2")
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([r.tobytes() for r in slots], pa.binary()),
            pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "slots", "grams"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    sets = arrow_map(texts, run, "doc_id bigint, slots binary, grams array<bigint>")
    sets = cut(sets.withColumn("node", F.xxhash64("grams")))
    one = sets.where(F.size("grams") > 0).groupBy("node").agg(F.min("slots").alias("slots"), F.min("grams").alias("grams"))
    one = cut(one)
    banded = one.select("node", F.inline(band_edges(F.col("slots"), bands, rows)))
    pairs = banded.toDF("x", "band", "key").join(banded.toDF("y", "band", "key"), ["band", "key"]).where(
        "x < y").select("x", "y").distinct()
    grams = one.select("node", "grams")
    both = pairs.join(grams.toDF("x", "gx"), "x").join(grams.toDF("y", "gy"), "y")
    shared = F.size(F.array_intersect("gx", "gy"))
    jaccard = shared / (F.size("gx") + F.size("gy") - shared)
    return sets, cut(both.select("x", "y", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold))
