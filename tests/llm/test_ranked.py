"""Ranked search against a plain version over all documents."""

import math
import random
import re
from collections import Counter

import pytest

from logloom.llm import ranked
from tests.llm.samples import SF, clashing, docs, empty, odd  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] of rows (doc_id, text), (item_id, text)."""
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in wanted.items():
        rows = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m))
                        for t in ts if b[t])
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def same(spark, docs, items, tmp_dir, k=10, **how):
    index = ranked.build_index(docs, f"{tmp_dir}/index")
    got = [tuple(r) for r in ranked.search(index, items, k, **how).collect()]
    assert sorted(got, key=str) == plain([(r.doc_id, r.text) for r in docs.collect()],
                                         [(r.item_id, r.text) for r in items.collect()], k)
    return index, got


def test_whole_tables_equal_plain_version(spark, docs, tmp_dir):
    index, got = same(spark, docs, spark.read.parquet(f"{SF}/benchmark.parquet"), tmp_dir)
    assert len(got) > 100 and index.docs <= docs.count()


def test_odd_rows(spark, odd, clashing, empty, tmp_dir):
    items = spark.createDataFrame([(1, "one TWO thirteen"), (2, None), (3, ""), (None, "word id"), (None, "b"), (4, "nowhere"),
                                   (5, "é 😀 naïve"), (1, "one TWO thirteen"), (6, "a b c d x z"), (7, "\x0b \x1f")],
                                  "item_id bigint, text string")
    same(spark, odd, items, tmp_dir)
    more = items.selectExpr("*", "1 as m", "2 as term", "3 as segment", "4 as score", "5 as doc_id")
    same(spark, clashing, more, f"{tmp_dir}/b", k=3)
    same(spark, empty, items, f"{tmp_dir}/c")
    same(spark, odd, items.limit(0), f"{tmp_dir}/d")


@pytest.mark.parametrize("k", [1, 4])
def test_ties_copies_and_blocks(spark, tmp_dir, k, monkeypatch):
    """Many equal texts, segments of three documents, items in several blocks."""
    monkeypatch.setattr(ranked, "SEGMENT_DOCS", 3)
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 5, 5, 5, 9, 40]))) for _ in range(60)] * 3
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    items = spark.createDataFrame([(i, " ".join(rng.choices(vocab, k=6))) for i in range(12)], "item_id bigint, text string")
    same(spark, docs, items, tmp_dir, k=k, block_terms=20)


def test_segments_hold_each_document_once(spark, docs, tmp_dir):
    index = ranked.build_index(docs, f"{tmp_dir}/index")
    heads = index.postings.where("term = ''").selectExpr("segment", "m", "explode(ids) as doc_id")
    assert heads.count() == index.docs == heads.select("doc_id").distinct().count()
    one_m = index.postings.groupBy("segment").agg({"m": "max", "segment": "max"}).count()
    assert index.postings.select("segment", "m").distinct().count() == one_m
    assert index.postings.selectExpr("sum(tf * n_docs) as n").first().n == index.terms
