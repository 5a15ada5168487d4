"""Benchmark decontamination: which test items lie inside which documents.

A document holds an item when it contains at least ``threshold`` of the
item's distinct word shingles.  Candidates come from bottom-k MinHash
sketches of the items, partitioned by size: items whose number of shingles
lies in [2^j, 2^(j+1)) form class j, and their sketch is their
k_j = floor((1 - threshold) * (2^(j+1) - 1)) + 1 least shingle hashes.  A
document that holds an item misses fewer than k_j of its shingles, so it
meets the sketch: no item is lost, however long the document.  Candidates are
verified by exact containment of the shingles' words.

Words are runs of letters, digits and non-ASCII characters, ASCII lower case.
An item of fewer words than a shingle is one shingle of all its words; an
item without words is in no document.

Items are taken in blocks of a bounded number and size, each block in one pass
over the documents without a shuffle.  The driver builds one block at a time
and lets go of it when it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from logloom.llm.common import arrow_map
from logloom.llm.features import Laid, lay_out, mix

SHINGLE = 5
THRESHOLD = 0.8
#: Items whose sketches and shingles a pass holds in memory.
BLOCK_ITEMS = 20_000
#: Text bytes of the items of a pass (one longer item is still taken whole).
BLOCK_BYTES = 32 << 20
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
               for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PREFILTER_BITS = 20
#: Candidates of a text that are counted at once.
_CANDIDATES = 2000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def shingles_of(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[i:] for i in range(n))))


def _run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _STEP + words[k:len(words) - n + 1 + k]
    return mix(out)


class Block:
    """Sketches and shingles of a block of items."""

    def __init__(self, ids: list, texts: list, threshold: float, shingle: int):
        self.threshold, self.ids, self.words, self.lens, self.grams = threshold, [], [], [], []
        laid = lay_out(pa.array(texts, pa.string()), _WORDS)
        hashes, at = laid.word_hashes, laid.word_range
        sketch, owner, length = [], [], []
        for i in range(len(ids)):
            words = hashes[at[i]:at[i + 1]]
            if len(words) == 0:
                continue
            n = min(shingle, len(words))
            grams = np.unique(_run_hashes(words, n))
            top = (2 << int(np.log2(len(grams)))) - 1  # largest size of the class
            k = int((1 - threshold) * top + 1e-9) + 1
            sketch.append(grams[:k])
            owner += [len(self.ids)] * len(sketch[-1])
            length += [n] * len(sketch[-1])
            self.ids.append(ids[i])
            self.words.append(texts[i])
            self.lens.append(n)
            self.grams.append(grams)
        flat = np.concatenate(sketch) if sketch else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.by_length = {}
        for n in sorted(set(length)):
            kept = order[np.array(length)[order] == n]
            seen = np.zeros(1 << _PREFILTER_BITS, bool)
            seen[flat[kept] >> np.uint64(64 - _PREFILTER_BITS)] = True
            self.by_length[n] = (seen, flat[kept], np.array(owner)[kept])

    def find(self, laid: Laid, texts: pa.Array):
        """(row, item index, shared shingles) of every item in every text."""
        hashes, at = laid.word_hashes, laid.word_range
        runs, hits, rows = {}, {}, set()
        for n, (seen, values, _) in self.by_length.items():
            run = runs[n] = _run_hashes(hashes, n)
            hit = np.flatnonzero(seen[run >> np.uint64(64 - _PREFILTER_BITS)])
            spot = np.minimum(np.searchsorted(values, run[hit]), len(values) - 1)
            hit = hit[values[spot] == run[hit]]
            row = np.searchsorted(at, hit, "right") - 1
            inside = hit + n <= at[row + 1]
            hits[n] = hit[inside], row[inside]
            rows.update(np.unique(row[inside]).tolist())
        for row in sorted(rows):
            for n, item in self._candidates(runs, hits, row):
                # what a text shares with its candidates, counted on hashes of distinct shingles
                own = np.unique(runs[n][at[row]:max(at[row], at[row + 1] - n + 1)])
                for few in np.array_split(item, -(-len(item) // _CANDIDATES)):
                    grams = np.concatenate([self.grams[i] for i in few])
                    size = np.array([len(self.grams[i]) for i in few])
                    same = own[np.minimum(np.searchsorted(own, grams), len(own) - 1)] == grams
                    shared = np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int64)
                    few = few[shared >= self.threshold * size - 1e-9]
                    if not len(few):
                        continue
                    exact = shingles_of(words_of(texts[row].as_py()), n)
                    for i in few.tolist():
                        whole = shingles_of(words_of(self.words[i]), n)
                        both = len(whole & exact)
                        if both >= self.threshold * len(whole) - 1e-9:
                            yield row, i, len(whole), both

    def _candidates(self, runs: dict, hits: dict, row: int):
        """(shingle length, places of items whose sketch the row meets): the
        row's distinct hashes are looked up, however often one occurs."""
        for n, (hit, of) in hits.items():
            a, b = np.searchsorted(of, [row, row + 1])
            if a == b:
                continue
            _, values, owner = self.by_length[n]
            found = np.unique(runs[n][hit[a:b]])
            lo = np.searchsorted(values, found, "left")
            many = np.searchsorted(values, found, "right") - lo
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield n, np.unique(owner[np.repeat(lo, many) + nth])


def _blocks(items: DataFrame, threshold: float, shingle: int, block_items: int, block_bytes: int) -> Iterator[Block]:
    """The distinct items, block by block; the driver reads a partition of
    about a block at a time."""
    items = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text is not null")
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    parts = max(1, -(-total.n // block_items), -(-total.size // block_bytes))
    ids, texts, held = [], [], 0
    # an iterator runs a job per partition: no more of them than blocks, however many the session makes
    for r in items.repartition(parts, "item_id", "text").distinct().coalesce(parts).toLocalIterator():
        size = len(r.text.encode("utf-8", "replace"))
        if ids and (len(ids) >= block_items or held + size > block_bytes):
            yield Block(ids, texts, threshold, shingle)
            ids, texts, held = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        held += size
    if ids:
        yield Block(ids, texts, threshold, shingle)


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE,
               block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shingles, shared, containment) for every row of
    ``docs`` (doc_id, text) and item (item_id, text) it holds.

    Null texts hold nothing and are held nowhere; repeated document rows each
    give rows, repeated items count once; null ids stay null; empty tables
    give an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    schema = "doc_id bigint, item_id bigint, n_shingles bigint, shared bigint, containment double"

    def search(block: Block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            b, texts = shared.value, batch.column(1)
            found = list(b.find(lay_out(texts, _WORDS), texts))
            return pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                pa.array([b.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                pa.array([f[3] for f in found], pa.int64()), pa.array([f[3] / f[2] for f in found], pa.float64())],
                ["doc_id", "item_id", "n_shingles", "shared", "containment"])

        return arrow_map(rows, run, schema)

    found = list(map(search, _blocks(items, threshold, shingle, block_items, block_bytes)))
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, found)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE,
                      block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` (all columns) that hold no item; null texts hold none,
    repeated rows stay or go together, empty tables (of either) lose nothing.

    One block of items is one pass.  With more, each block's pass finds the
    texts that hold one of its items, and rows with such a text (by MD5) go:
    no task holds more than one block."""
    at = docs.columns.index("text")

    def clean(block: Block, rows: DataFrame, at: int, holding: bool) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at)
            held = np.zeros(batch.num_rows, bool)
            held[[f[0] for f in shared.value.find(lay_out(texts, _WORDS), texts)]] = True
            return batch.filter(pa.array(held == holding))

        return arrow_map(rows, run, rows.schema)

    blocks = _blocks(items, threshold, shingle, block_items, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return clean(first, docs, at, False)
    texts = docs.select("text")
    found = [clean(block, texts, 0, True).select(F.md5("text").alias("held")).distinct()
             for block in chain([first, second], blocks)]
    held = reduce(DataFrame.unionAll, found).distinct()
    return docs.join(held, F.md5(docs["text"]) == held["held"], "left_anti")


ORACLE = """
WITH w(kind, id, body) AS (
  SELECT 'd', doc_id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(
    translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+'), lambda x: x <> '') AS ws
  FROM w),
items AS (SELECT id AS item_id, ws, least(5, len(ws)) AS n FROM words WHERE kind = 'i' AND len(ws) > 0),
item_grams AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2),
    lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
  FROM items),
doc_grams AS (
  SELECT DISTINCT id AS doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2),
    lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
  FROM words, (SELECT DISTINCT n FROM items) WHERE kind = 'd' AND len(ws) >= n),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_grams GROUP BY item_id)
SELECT d.doc_id, i.item_id, s.n_shingles, count(*) AS shared, count(*) / s.n_shingles AS containment
FROM doc_grams d JOIN item_grams i USING (n, g) JOIN sizes s USING (item_id)
GROUP BY d.doc_id, i.item_id, s.n_shingles HAVING count(*) >= 0.8 * s.n_shingles - 1e-9
"""
