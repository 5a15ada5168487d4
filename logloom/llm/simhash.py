"""SimHash near-duplicates, candidates by a Golay-code fuzzy hash.

The binary Golay code [23, 12, 7] is perfect: every 23-bit word lies within
three bits of exactly one codeword, so decoding maps words to 4096 indices.
Two words at most two bits apart have a word between them, one bit from each;
hence the sets "indices of all words within one bit of x" of the two share an
index.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits, padded
with zeros).  When two fingerprints differ in at most ``max_bits`` = 4 bits,
the two best of the three segments hold at most two of the errors
(pigeonhole).  So for each pair of segments a fingerprint gives the keys
(index, index) of all words within one bit of the two segments taken together
- about 29 keys of 24 bits - and two linked fingerprints share one of them.
Candidates are verified by their exact bit distance.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType

from logloom.llm.common import LOWER, arrow_map, cut
from logloom.llm.components import connected_components

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4
SEED = 42


# ------------------------------------------------------------ fingerprints

def shingle_hashes(text: str | None, shingle: int = 4) -> list[int]:
    """XXH64 (seed 42) of the word shingles of a whole text, repeats included:
    ASCII-lower-cased words between ASCII blanks, space-joined.  Fewer words
    than ``shingle``: the whole sequence is the one shingle; no words: none."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if len(words) < shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    runs = zip(*(itertools.islice(words, i, None) for i in range(shingle)))
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, runs), itertools.repeat(SEED)))


_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit value per run of ``counts[i]`` hashes: the bits set in over
    half of them (no hashes: zero).

    Eight byte-wide counters share a word, so each bit of the eight bytes is
    summed over blocks of at most 255 hashes of one text."""
    full = counts > 0
    out = np.zeros(len(counts), np.uint64)
    if not full.any():
        return out
    sizes = counts[full].astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    blocks = -(-sizes // 255)
    first = np.cumsum(blocks) - blocks
    edges = np.repeat(starts, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    bits = np.empty((len(sizes), 8, 8), bool)  # [text, byte, bit in byte]
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, edges)
        per_text = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits[:, :, k] = per_text * 2 > sizes[:, None]
    out[full] = np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprint_batch(texts: pa.Array, shingle: int = 4) -> np.ndarray:
    """SimHash of each text as a signed 64-bit number."""
    each = [shingle_hashes(t.as_py(), shingle) for t in texts]
    counts = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.fromiter(itertools.chain.from_iterable(each), np.uint64, int(counts.sum()))
    return majority(flat, counts).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint BIGINT: the 64 bits as a signed number), one row
    per row of ``docs``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprint_batch(batch.column(1), shingle))],
                                          ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id bigint, fingerprint bigint")


# -------------------------------------------------------------- Golay keys

def _remainder(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.uint32).copy()
    for i in range(22, 10, -1):
        rest ^= ((rest >> np.uint32(i)) & np.uint32(1)) * np.uint32(GENERATOR << (i - 11))
    return rest


@lru_cache(maxsize=1)
def _error_of() -> np.ndarray:
    """Error pattern (at most three bits) of each of the 2048 syndromes."""
    errors = np.array([sum(1 << i for i in c) for k in range(4) for c in itertools.combinations(range(23), k)],
                      np.uint32)
    out = np.zeros(2048, np.uint32)
    out[_remainder(errors)] = errors
    return out


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    return (words ^ _error_of()[_remainder(words)]) >> np.uint32(11)


def golay_keys(values: np.ndarray) -> list[np.ndarray]:
    """The distinct keys of each 64-bit fingerprint, as BIGINT numbers."""
    values = values.astype(np.uint64)
    exact, near = [], []
    for start, width in SEGMENTS:
        seg = ((values >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
        exact.append(decode(seg).astype(np.int64)[:, None])
        near.append(decode((seg[:, None] ^ flips).reshape(-1)).reshape(len(seg), -1).astype(np.int64))
    keys = []
    for which, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = np.concatenate([near[i] << 12 | exact[j], exact[i] << 12 | near[j]], axis=1)
        keys.append(both | which << 24)
    keys = np.sort(np.concatenate(keys, axis=1), axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return [k[f] for k, f in zip(keys, first)]


def _key_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    values = batch.column(0).to_numpy().view(np.uint64)
    out_v, out_k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(values), 20_000):
        part = values[at:at + 20_000]
        keys = golay_keys(part)
        out_k.append(np.concatenate(keys))
        out_v.append(np.repeat(part.view(np.int64), [len(k) for k in keys]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_k)), pa.array(np.concatenate(out_v))],
                                      ["key", "fp"])


def _apart(x, y):
    return F.bit_count(x.bitwiseXOR(y))


def _turned(fp, bits: int):
    """The fingerprint with its ``bits`` highest bits moved to the low end."""
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits)) if bits else fp


def _orders(key, fp) -> list:
    """Three numbers to sort a bucket by.  All begin in the segment that the
    key leaves free, each at another third of it, so that members which differ
    in a few bits lie side by side in one of them."""
    kind = F.shiftright(key, 24)
    return [F.when(kind == 0, _turned(fp, third)).when(kind == 1, _turned(fp, 21 + third))
            .otherwise(_turned(fp, 42 + third)) for third in (0, 7, 14)]


def fingerprint_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (column ``fingerprint``) to (node, component),
    for those that a chain of links of at most ``max_bits`` bits ties to
    another one.

    First every key's bucket is sorted in three orders and neighbours are
    compared, which ties dense groups together with three rows per member.
    Then a bucket's pairs are compared where they can still join components: a
    bucket that holds one component is left out, and in the others only pairs
    with a member outside the bucket's largest component are met, so a group
    of near copies is never compared, nor expanded, pair by pair.  Two large
    components that share a bucket and have no link are compared in full.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the segment keys are complete up to {MAX_BITS} bits")
    distinct = prints.select("fingerprint").distinct()
    keyed = cut(arrow_map(distinct, _key_batch, "key bigint, fp bigint"))
    bucket = Window.partitionBy("key")
    key, fp = F.col("key"), F.col("fp")
    beside = keyed.select("key", "fp", *[o.alias(f"o{k}") for k, o in enumerate(_orders(key, fp))])
    for k in range(3):
        beside = beside.withColumn(f"b{k}", F.lag("fp").over(bucket.orderBy(f"o{k}")))
    near = beside.select("fp", F.explode(F.array("b0", "b1", "b2")).alias("before")).where(
        F.col("before").isNotNull() & (_apart(fp, F.col("before")) <= max_bits))
    first = connected_components(near, "fp", "before")

    tied = keyed.join(first.withColumnRenamed("node", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("component", "fp").alias("comp"))
    several = tied.select("*", F.min("comp").over(bucket).alias("lo"), F.max("comp").over(bucket).alias("hi")).where(
        "lo <> hi")
    members = F.count("*").over(Window.partitionBy("key", "comp"))
    several = several.withColumn("members", members).withColumn(
        "largest", F.max(F.struct("members", "comp")).over(bucket)["comp"])
    several = cut(several.select("key", "fp", "comp", (F.col("comp") == F.col("largest")).alias("most")))
    left = several.where("NOT most").select("key", "fp", "comp")
    right = several.toDF("key", "fp2", "comp2", "most2")
    between = left.join(right, "key").where((F.col("most2") | (F.col("comp") < F.col("comp2")))
                                            & (_apart(fp, F.col("fp2")) <= max_bits))
    second = connected_components(between, "comp", "comp2")
    # component of a component: through the node's first component
    nodes = first.unionAll(second.join(first, second["node"] == first["component"], "left_anti")
                           .select("node", F.col("node").alias("component")))
    up = second.toDF("component", "top")
    return cut(nodes.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint BIGINT, component_id): one row per row of
    ``docs``; component_id is the smallest doc_id reachable over links of at
    most ``max_bits`` differing bits, itself included.

    Null and blank texts have fingerprint zero and link like any other; null
    ids never name a component that has another id; an empty table gives an
    empty table; repeated rows each give their row.
    """
    prints = cut(fingerprints(docs, shingle, id_col, text_col))
    comps = fingerprint_components(prints, max_bits)
    # smallest id per fingerprint first: copies meet in the map-side combine
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    of = least.join(comps.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    tops = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(tops, "component").select("fingerprint", "component_id")
    return prints.join(of, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``docs`` without near duplicates: of each component the row
    with the smallest doc_id (of rows that share it, that whose columns hash
    lowest) stays.  A component whose ids are all null keeps one row too."""
    plain = [f.name for f in docs.schema if isinstance(f.dataType, AtomicType) and f.name != "text"]
    mark = F.xxhash64("text", *plain)
    prints = cut(_marked_prints(docs.select("doc_id", "text", mark.alias("row_mark")), shingle))
    comps = fingerprint_components(prints, max_bits)
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row_mark").alias("m"))
    least = prints.groupBy("fingerprint").agg(F.min(rank).alias("least"))
    of = least.join(comps.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        F.coalesce("component", "fingerprint").alias("component"), "least")
    keep = of.groupBy("component").agg(F.min("least").alias("least")).select(
        F.col("least.d").alias("keep_id"), F.col("least.m").alias("keep_mark"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), mark.alias("row_mark"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row_mark") == F.col("keep_mark")),
                     "left_semi")
    same = Window.partitionBy("id", "row_mark").orderBy("row_mark")  # rows alike in all columns
    return kept.withColumn("nth", F.row_number().over(same)).where("nth = 1").select("row.*")


def _marked_prints(rows: DataFrame, shingle: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = pa.array(fingerprint_batch(batch.column(1), shingle))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), prints],
                                          ["doc_id", "row_mark", "fingerprint"])

    return arrow_map(rows, run, "doc_id bigint, row_mark bigint, fingerprint bigint")
