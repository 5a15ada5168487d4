"""Fill in middle against a plain regular-expression version."""

import hashlib
import random
import re

import numpy as np
import pytest

from logloom.llm import fim
from tests.llm.samples import clashing, docs, empty, odd  # noqa: F401

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain(doc_id, text, rate=90, spm_rate=20):
    text = text or ""
    u = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    if h4 % 100 < spm_rate:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def same(df, **how):
    from pyspark.sql import functions as F

    out = fim.transform(df, **how)
    out = out.withColumn("back", fim.restored(F.col("output"), F.col("form")))
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()), key=key)
    want = sorted(((r.doc_id, *plain(r.doc_id, r.text, **how), r.text or "") for r in df.collect()), key=key)
    assert got == want
    return got


def test_tree_sums_and_descends():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 8, 9, 31, 100):
        rows = np.array([[rng.randrange(4), rng.randrange(9)] for _ in range(n)], np.int64).reshape(n, 2)
        tree = fim.Fenwick(rows)
        if n:
            tree.add(n // 2, np.array([3, 1]))
            rows[n // 2] += [3, 1]
        total = np.concatenate([[[0, 0]], np.cumsum(rows, axis=0)])
        for k in range(n + 1):
            assert tree.before(k).tolist() == total[k].tolist()
        for target in range(int(total[-1, 0]) + 2):
            at, sums = tree.descend(target)
            want = max(k for k in range(n + 1) if total[k, 0] <= target)
            assert (at, sums.tolist()) == (want, total[want].tolist())


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_cuts_of_any_block_size(block):
    rng = random.Random(block)
    for _ in range(60):
        text = "".join(rng.choice("ab Zé\U0001f600\n9ñ") for _ in range(rng.randrange(40)))
        u = UNIT.findall(text)
        units = fim.Units(np.frombuffer(text.encode(), np.uint8), block)
        assert units.n == len(u) and units.points == len(text)
        for k in range(len(u) + 1):
            head = "".join(u[:k])
            assert units.cut(k) == (len(head.encode()), len(head))


def test_whole_query_equals_plain_version(docs):
    forms = {r[2] for r in same(docs)}
    assert forms == {"plain", "psm", "spm"}


def test_odd_rows_and_clashing_names(odd, clashing, empty):
    same(odd)
    same(clashing)
    same(empty)
    same(odd, rate=100, spm_rate=100)


def test_sentinels_in_texts_and_halves_of_them(spark):
    texts = ["a<P>b", "<S>", "x <M> y", "a<S", "S>b<M", "<P", "P>", "<<P", "<S<S", "M><M", "\x00<\x00S>", "a" * 50_000 + "<P",
             "é" * 30_000, "<S>" * 3]
    got = same(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string"), rate=100)
    assert [r[2] for r in got].count("plain") == 4


def test_rate_zero_leaves_all_plain(docs):
    from pyspark.sql import functions as F

    out = fim.transform(docs, rate=0).where("form <> 'plain'")
    assert out.count() == 0 and fim.digests(fim.transform(docs)).where(
        F.col("restored_sha256").isNull() | F.col("output_sha256").isNull()).count() == 0
