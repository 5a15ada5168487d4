"""Ranked lexical search over a length-stratified index.

Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased.  With N documents that have a term, L terms in all of them and n
in one, a document's length normaliser is m = 10 + (90 n N) div L.  A term
found in df documents weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a
document scores the sum of w * ((10^9 tf) div (1000 tf + 8 m)) over the
query's terms: saturating in tf, damped by length.

Documents of one m form a stratum.  The index deals documents out by ranges
of m, so strata lie together, and cuts them into segments of a bounded number
of documents and bytes; every segment lists per term and tf (ascending) the
places of its documents, sorted by id.  Inside a stratum a posting's impact
follows from tf alone: it is computed once per (term, tf), and the last tf of
a term gives its upper bound.

A search visits an item's strata by descending bound: first those that surely
hold k matching documents; the k-th score found there is the item's threshold,
and only strata and segments whose bound reaches it are visited after that.
No document that could be among the k best is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logloom.llm.common import SLICE_BYTES, arrow_map, cut, slices
from logloom.llm.features import lay_out
from logloom.session import scratch_path, ship_package
from logloom.sinks import fs

#: Most documents of a segment.
SEGMENT_DOCS = 4096
#: Text bytes of a part of the index, where the session's number of shuffle partitions does not make parts smaller.
PART_BYTES = 64 << 20
#: (item, term) pairs that a pass over the index holds in memory.
BLOCK_TERMS = 500_000
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
               for c in range(256))
POSTINGS = ("segment bigint, m bigint, term string, tf bigint, n_docs bigint, docs array<int>, ids array<bigint>")


# ------------------------------------------------------------------ terms

def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all terms in order, number of terms before each text and in all)."""
    laid = lay_out(texts, _WORDS)
    starts, ends = laid.words
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=off[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(off), pa.py_buffer(laid.data[laid.data != 32].tobytes())])
    return found, laid.word_range.astype(np.int64)


def _sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(terms, bytes) of each text."""
    laid = lay_out(batch.column("text"), _WORDS)
    return pa.RecordBatch.from_arrays([pa.array(np.diff(laid.word_range), pa.int64()), pa.array(laid.ends - laid.starts, pa.int64())],
                                      ["n", "size"])


# ------------------------------------------------------------------ index

@dataclass
class Index:
    """An index below ``path`` of ``docs`` documents with ``terms`` terms."""

    spark: SparkSession
    path: str
    docs: int
    terms: int

    @property
    def postings(self) -> DataFrame:
        """(segment, m, term, tf, n_docs, docs, ids): places of the documents
        that hold the term tf times; the row of term '' has the segment's
        document ids by place."""
        return self.spark.read.schema(POSTINGS).parquet(self.path)

    def weight(self, df: Column) -> Column:
        return F.floor(1000 * F.log((2 * F.lit(self.docs).cast("double") + 2) / (2 * df + 1))).cast("bigint")


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def build_index(docs: DataFrame, path: str) -> Index:
    """Index every row of ``docs`` (doc_id, text) below ``path``.

    Null, empty and term-less texts are no documents of the index; repeated
    rows are documents of their own; null ids are kept; an empty table gives
    an index without rows.  Equal normalisers are dealt by a hash of id and
    text, so a stratum of any size is many tasks' work.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    sizes = arrow_map(rows.select("text"), _sizes, "n bigint, size bigint").where("n > 0")
    by_n = cut(sizes.groupBy("n").agg(F.count("*").alias("docs"), F.sum("size").alias("size")))
    total = by_n.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0))
                     .alias("terms"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    index = Index(spark, path, total.n, total.terms)
    if total.n == 0:
        spark.createDataFrame([], POSTINGS).write.parquet(path)
        return index
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total.size // PART_BYTES))
    shares = ", ".join(f"{k / parts}D" for k in range(1, parts)) or "0.5D"
    # fewer than ``parts`` numbers; every part gets about as many bytes, so long documents share parts with few
    cuts = by_n.select(F.expr(f"10 + (90L * n * {total.n}L) div {total.terms}L").alias("m"), (F.col("size") / 1024 + 1)
                       .cast("bigint").alias("kb")).agg(F.expr(f"percentile(m, array({shares}), kb)")).first()[0]
    cuts = np.floor(cuts).astype(np.int64) if parts > 1 else np.zeros(0, np.int64)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = _sizes(batch).column(0).to_numpy()
        m = 10 + 90 * n * total.n // total.terms
        low, high = np.searchsorted(cuts, m, "left"), np.searchsorted(cuts, m, "right")
        part = low + batch.column("h").to_numpy() % (high - low + 1)  # a stratum over all parts that it reaches into
        out = pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(m), *batch.columns], ["part", "m", "doc_id", "text", "h"])
        return out.filter(pa.array(n > 0))

    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    dealt = arrow_map(hashed, deal, "part int, m bigint, doc_id bigint, text string, h bigint")
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("m", "h").select("m", "doc_id", "text")
    dealt.mapInArrow(_invert, POSTINGS).write.parquet(path)
    return index


def _invert(batches):
    """Sorted rows (m, doc_id, text) to the postings of segment after segment."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held, docs, size, stratum = [], 0, 0, None
    for batch in batches:
        for part in slices(batch):
            m = part.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if held and (m[a] != stratum or docs >= SEGMENT_DOCS or size >= SLICE_BYTES):
                    yield _segment(number, stratum, held)
                    number, held, docs, size = number + 1, [], 0, 0
                stratum = int(m[a])
                held.append(part.slice(a, b - a))
                docs, size = docs + b - a, size + held[-1].column(2).nbytes
    if held:
        yield _segment(number, stratum, held)


def _segment(number: int, m: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks()
    rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending")], null_placement="at_end"))
    n = rows.num_rows
    found, at = tokens(rows.column("text").combine_chunks())
    coded = found.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    # (term, document) with the number of its occurrences
    key = rank[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), np.diff(at))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(first, len(key)))
    term, doc = np.divmod(key[first], n)
    by = np.lexsort((tf, term))  # stable: documents stay in order
    term, tf, doc = term[by], tf[by], doc[by].astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
    many = np.diff(np.append(first, len(term)))
    k = len(first)
    names = coded.dictionary.take(order).take(pa.array(term[first])).cast(pa.large_string()).cast(pa.string())
    ids = pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows.column("doc_id").combine_chunks()),
                            pa.nulls(k, pa.list_(pa.int64()))])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0, 0], np.cumsum(many)]), pa.int32()), pa.array(doc))
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(k + 1, number)), pa.array(np.full(k + 1, m)), pa.concat_arrays([pa.array([""]), names]),
        pa.array(np.append(0, tf[first])), pa.array(np.append(0, many)), lists, ids],
        ["segment", "m", "term", "tf", "n_docs", "docs", "ids"])


# ----------------------------------------------------------------- search

@dataclass
class Block:
    """Items with their terms: those of item i are ``term[at[i]:at[i + 1]]``,
    places in ``names``."""

    items: list
    names: pa.Array
    at: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    #: Least score wanted of each item.
    least: np.ndarray
    #: Item places to visit by stratum; None: every item, wherever its bound reaches.
    visits: dict | None = None

    @classmethod
    def of(cls, rows: pa.Table) -> "Block":
        """``rows``: (item_id, term, w) sorted by item."""
        ids = rows.column("item_id").combine_chunks()
        names = rows.column("term").combine_chunks().dictionary_encode()
        plain = np.array(ids.to_pylist(), object)
        edge = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
        return cls(plain[edge].tolist(), names.dictionary, np.append(edge, len(plain)), names.indices.to_numpy().astype(np.int64),
                   rows.column("w").to_numpy(), np.ones(len(edge), np.int64))


class Best:
    """The k best (score, id) of every item met so far."""

    def __init__(self, block: Block, k: int):
        self.k, self.least, self.found = k, block.least.copy(), [[] for _ in block.items]

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        rows = self.found[item] + [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids)]
        self.found[item] = rows = sorted(rows)[:self.k]
        if len(rows) == self.k:
            self.least[item] = max(self.least[item], -rows[-1][0])


def visit(block: Block, best: Best, m: int, terms: pa.Array, tf: np.ndarray, edges: np.ndarray, docs: np.ndarray,
          ids: pa.Array) -> None:
    """Score one segment.  ``terms``, ``tf``: its postings by term, then tf;
    posting j has the documents ``docs[edges[j]:edges[j + 1]]``."""
    worth = impact(tf, m)  # once per (term, tf)
    code = pc.index_in(terms, value_set=block.names).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    stop = np.append(first[1:], len(code))
    lo, hi = np.zeros(len(block.names), np.int64), np.zeros(len(block.names), np.int64)
    top = np.zeros(len(block.names), np.int64)
    if len(first):
        lo[code[first].astype(int)], hi[code[first].astype(int)] = edges[first], edges[stop]
        top[code[first].astype(int)] = worth[stop - 1]
    bound = np.add.reduceat(block.weight * top[block.term], block.at[:-1])
    each = np.repeat(worth, np.diff(edges))
    chosen = np.flatnonzero(bound >= best.least)
    if block.visits is not None:
        chosen = np.intersect1d(chosen, block.visits.get(m, []))
    for i in chosen[np.argsort(-bound[chosen], kind="stable")].tolist():
        if bound[i] < best.least[i]:
            continue
        a, b = block.at[i], block.at[i + 1]
        spans = [(lo[t], hi[t], w) for t, w in zip(block.term[a:b].tolist(), block.weight[a:b].tolist()) if hi[t] > lo[t]]
        score = np.zeros(len(ids), np.int64)
        place = np.concatenate([docs[x:y] for x, y, _ in spans])
        value = np.concatenate([each[x:y] * w for x, y, w in spans])
        if bound[i] < 1 << 53:  # sums of doubles are exact
            score = np.bincount(place, value, len(ids)).astype(np.int64)
        else:
            np.add.at(score, place, value)
        hit = np.flatnonzero(score >= best.least[i])
        if len(hit):
            if len(hit) > 4 * best.k:  # places are in order of ids: of equal scores the first stay
                hit = hit[np.argsort(-score[hit], kind="stable")[:best.k]]
            best.add(i, score[hit], ids.take(pa.array(hit)).to_pylist())


def _scan(shared, k: int):
    """Postings sorted by (segment, term, tf) to (item_id, doc_id, score)."""
    def run(batches):
        block = shared.value
        best = Best(block, k)
        held, segment = [], None

        def close():
            rows = pa.Table.from_batches(held).combine_chunks()
            docs, ids = (rows.column(c).combine_chunks() for c in ("docs", "ids"))
            edges = docs.offsets.to_numpy()[1:] - docs.offsets[1].as_py()
            visit(block, best, rows.column("m")[0].as_py(), rows.column("term").combine_chunks()[1:],
                  rows.column("tf").to_numpy()[1:], edges, docs[1:].flatten().to_numpy(), ids[0].values)

        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if held and number[a] != segment:
                    close()
                    held = []
                segment = number[a]
                held.append(batch.slice(a, b - a))
        if held:
            close()
        rows = [(block.items[i], None if none else doc, -s) for i, found in enumerate(best.found) for s, none, doc in found]
        names = ["item_id", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names)
    return run


def _top(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents above 0 of every
    item (item_id, text), equal scores by ascending doc_id (nulls last).

    Null and term-less items, and those none of whose terms is in a document,
    have no rows; rows of one item_id, null included, count as one item with
    all their terms; an empty table gives an empty table.  Items are taken in
    blocks of about ``block_terms`` (item, term) pairs.
    """
    spark = index.spark
    root = scratch_path(spark, "search")

    def kept(df: DataFrame, name: str) -> DataFrame:
        """A table of known size, so that Spark chooses how to join it."""
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    def terms_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, at = tokens(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(at) - 1), np.diff(at)))),
                                           found.cast(pa.large_string()).cast(pa.string())], ["item_id", "term"])

    try:
        texts = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
        wanted = kept(arrow_map(texts, terms_of, "item_id bigint, term string").distinct(), "wanted")
        vocabulary = kept(wanted.select("term").distinct(), "vocabulary")
        strata = kept(index.postings.select("term", "m", "tf", "n_docs").join(vocabulary, "term").groupBy("term", "m").agg(
            F.max("tf").alias("tf"), F.sum("n_docs").alias("n_docs")), "strata")
        weights = strata.groupBy("term").agg(index.weight(F.sum("n_docs")).alias("w")).where("w > 0")
        weighted = kept(wanted.join(weights, "term"), "weighted")
        pairs = weighted.count()
        blocks = -(-pairs // block_terms)
        out = [_search_block(index, weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), strata, k,
                             lambda df, name, b=b: kept(df, f"{name}-{b}")) for b in range(blocks)]
        found = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint, rank int")
        for part in out:
            found = found.unionByName(part)
        return cut(found.select("item_id", "rank", "doc_id", "score"))  # k rows an item
    finally:
        fs.delete(spark, root)


def _search_block(index: Index, weighted: DataFrame, strata: DataFrame, k: int, kept) -> DataFrame:
    spark = index.spark
    rows = weighted.orderBy("item_id").toArrow()
    if rows.num_rows == 0:
        return spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint, rank int")
    block = Block.of(rows)
    place = {item: i for i, item in enumerate(block.items)}
    worth = F.expr("w * ((1000000000L * tf) div (1000 * tf + 8 * m))")
    bounds = kept(weighted.join(strata, "term").groupBy("item_id", "m").agg(
        F.sum(worth).alias("bound"), F.max("n_docs").alias("surely")).where("bound > 0"), "bounds")
    head = spark.createDataFrame([("",)], "term string")
    terms = kept(weighted.select("term").distinct().unionAll(head), "terms")

    def scan(ms: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        post = index.postings.join(ms, "m", "left_semi").join(terms, "term", "left_semi")
        dealt = post.select("segment", "m", "term", "tf", "docs", "ids").repartition("segment")
        return _top(dealt.sortWithinPartitions("segment", "term", "tf").mapInArrow(
            _scan(shared, k), "item_id bigint, doc_id bigint, score bigint"), k)

    # by descending bound, as many strata of each item as surely hold k documents
    by = Window.partitionBy("item_id").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("surely").over(by), F.lit(0))
    first = kept(bounds.withColumn("before", before).where(F.col("before") < k).select("item_id", "m"), "first")
    block.visits = {}
    for r in first.toLocalIterator():  # at most k an item
        block.visits.setdefault(r.m, []).append(place[r.item_id])
    ship_package(spark)
    seen = scan(kept(first.select("m").distinct(), "first-m"))
    for r in seen.where(F.col("rank") == k).toLocalIterator():
        block.least[place[r.item_id]] = r.score
    # every stratum that may reach an item's threshold
    block.visits = None
    least = kept(spark.createDataFrame(list(zip(block.items, block.least.tolist())), "item_id bigint, least bigint"), "least")
    reach = bounds.alias("b").join(least.alias("l"), F.expr("b.item_id <=> l.item_id")).where("bound >= least")
    return scan(kept(reach.select("m").distinct(), "reach"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS N, CAST(sum(len(ws)) AS BIGINT) AS L FROM d WHERE len(ws) > 0),
x AS (SELECT r, doc_id, 10 + (90 * len(ws) * N) // L AS m, ws FROM d, s WHERE len(ws) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(m) AS m, term, count(*) AS tf
      FROM (SELECT r, doc_id, m, unnest(ws) AS term FROM x) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, N),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
scored AS (
  SELECT q.item_id, p.r, any_value(p.doc_id) AS doc_id,
         CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) GROUP BY q.item_id, p.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0) WHERE rank <= 10
"""
