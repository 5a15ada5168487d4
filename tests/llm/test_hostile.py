"""Texts made to be slow: repeated shingles, hits and exceptions without end,
more blocks of items than one."""

import time

import numpy as np
import pyarrow as pa

from logloom.llm import containment, toxicity
from logloom.llm.features import lay_out
from tests.llm.samples import clashing, empty, odd  # noqa: F401

OPENING = "answer the following question with one of the choices given below please "


def test_shared_opening_repeated_in_a_long_text():
    rng = np.random.default_rng(0)
    items = [OPENING + " ".join(f"w{rng.integers(10**6)}" for _ in range(30)) for _ in range(3000)]
    block = containment.Block(list(range(len(items))), items, 0.8, 5)
    texts = pa.array([OPENING * 20_000, items[7] + " tail", OPENING + "x", "", "w1"])
    start = time.time()
    found = list(block.find(lay_out(texts, containment._WORDS), texts))
    assert [(r, i) for r, i, _, _ in found] == [(1, 7)] and time.time() - start < 10


def test_hits_and_exceptions_in_one_pass():
    lexicon = toxicity.Lexicon({"bad": 1.0, "bad lu": 0.5, "luck": 0.25}, ["bad luck", "luck of the", "so bad"])
    auto = lexicon.automaton()

    def plain(text):
        found, safe = [], []
        for end, (length, weight) in auto.iter(text):
            (safe if weight is None else found).append((end - length + 1, end, weight))
        return sum(w for a, b, w in found if not any(x <= a and b <= y for x, y, _ in safe))

    rng = np.random.default_rng(1)
    for _ in range(200):
        text = " " + " ".join(rng.choice(["bad", "luck", "of", "the", "so", "badly", "x"], rng.integers(0, 30))) + " "
        assert toxicity.hits(auto, text) == plain(text)
    start = time.time()
    toxicity.hits(auto, " " + "bad luck bad " * 100_000)
    assert time.time() - start < 5


def test_toxic_scores_keep_clashing_columns_out(spark, odd, clashing, empty):
    lexicon = toxicity.Lexicon({"thirteen": 2.0})
    a = sorted((str(r.doc_id), r.score) for r in toxicity.score(odd, lexicon).collect())
    assert a == sorted((str(r.doc_id), r.score) for r in toxicity.score(clashing, lexicon).collect())
    assert toxicity.score(empty, lexicon).count() == 0


def test_many_blocks_drop_what_one_block_drops(spark, clashing):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["one two three four five six", "no id here", "a b c d e", "none of it at all"])],
                                  "item_id bigint, text string")
    key = lambda rows: sorted(map(str, rows))
    one = containment.drop_contaminated(clashing, items)
    many = containment.drop_contaminated(clashing, items, block_items=1)
    assert key(one.collect()) == key(many.collect()) and one.columns == many.columns == clashing.columns
    assert 0 < one.count() < clashing.count()
    assert containment.drop_contaminated(clashing, items.limit(0)).count() == clashing.count()
    assert containment.drop_contaminated(clashing.limit(0), items, block_items=1).count() == 0
