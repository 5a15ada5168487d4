"""Full-text search: small cases, and agreement with SQLite FTS5
(porter unicode61 remove_diacritics 1) used here only as a test oracle."""

import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from logloom.functions.porter import stem
from logloom.functions.stem import terms
from logloom.functions.tokenize import tokenize_py
from logloom.operators import search as S

MESSAGES = ["heated kettles whistle early", "kettle dropped near the oven", "oven reached target in 90ms"]


@pytest.fixture(scope="module")
def msgs(spark):
    df = spark.createDataFrame([(i + 1, m) for i, m in enumerate(MESSAGES)], "id long, message string")
    return df.withColumn("terms", terms("message")).cache()


def hits(df, match):
    return sorted(r.id for r in S.search(df, match).select("id").collect())


def test_small_cases(msgs):
    assert hits(msgs, S.term("kettle")) == [1, 2]              # plural and singular meet in the stem
    assert hits(msgs, S.phrase("kettle dropped")) == [2]
    assert hits(msgs, S.phrase("dropped kettle")) == []
    assert hits(msgs, S.term("kettle") & S.term("oven")) == [2]
    assert hits(msgs, S.term("heated") | S.term("target")) == [1, 3]
    assert hits(msgs, S.prefix("kett")) == [1, 2]
    assert hits(msgs, S.term("teapot")) == []


def test_more_operators(msgs):
    assert hits(msgs, S.term("kettle") - S.term("oven")) == [1]
    assert hits(msgs, S.term("kettle") & ~S.term("oven")) == [1]
    assert hits(msgs, S.near("kettle", "oven", n=3)) == [2]
    assert hits(msgs, S.near("oven", "kettle", n=2)) == []
    assert hits(msgs, S.initial("oven")) == [3]
    assert hits(msgs, S.all_words("ovens dropping")) == [2]
    assert hits(msgs, S.term("90ms")) == [3]          # digits take part: 90ms -> 90m
    assert hits(msgs, S.prefix("whistling")) == [1]   # the prefix is stemmed first
    assert hits(msgs, S.Phrase(("kettl", "dro"), prefix=True)) == [2]
    assert S.all_words("   ") is None


def test_text_without_tokens_occurs_nowhere(msgs):
    for match in (S.term("!!!"), S.phrase("- -"), S.all_words("!!!"), S.all_words("oven !!!"), S.near("oven", "?", n=9)):
        assert hits(msgs, match) == []
    assert hits(msgs, S.term("oven") - S.term("!!!")) == [2, 3] and hits(msgs, S.term("!!!") | S.term("oven")) == [2, 3]


MARKED = ["cafe\u0301s au lait", "cafés au lait", "cafes au lait", "n\u0303andu\u0331 z", "a\u0300\u0301b c", "x\u0345y", "\u0301 alone"]


def test_decomposed_accents_like_fts5(spark):
    con = _fts(list(enumerate(MARKED)))
    df = spark.createDataFrame(list(enumerate(MARKED)), "id long, message string").withColumn("terms", terms("message"))
    for word in ("cafe", "cafes", "cafe\u0301", "lait", "nandu", "ab", "b", "xy", "alone", "y"):
        want = sorted(r[0] for r in con.execute("select rowid from f where f match ?", (f'"{word}"',)))
        assert hits(df, S.term(word)) == want, word


def _fts(texts):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(m, tokenize='porter unicode61 remove_diacritics 1')")
    con.executemany("insert into f(rowid, m) values (?, ?)", [(i, t) for i, t in texts])
    return con


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text from '{SF_SMALL}/documents.parquet'").fetchall()


def test_stemmer_matches_fts5_vocabulary(docs):
    con = _fts(docs)
    con.execute("create virtual table v using fts5vocab(f, 'row')")
    fts = {r[0] for r in con.execute("select term from v")}
    mine = {stem(t) for _, text in docs for t in tokenize_py(text)}
    assert mine == fts


@pytest.mark.parametrize("query,build", [
    ("worthless", lambda: S.term("worthless")),
    ('"the and"', lambda: S.phrase("the and")),
    ("ther*", lambda: S.prefix("ther")),
    ("ing OR ed", lambda: S.term("ing") | S.term("ed")),
    ("the NOT and", lambda: S.term("the") - S.term("and")),
    ("NEAR(the and, 3)", lambda: S.near("the", "and", n=3)),
    ("the AND and", lambda: S.term("the") & S.term("and")),
    ("NEAR(of and is, 4)", lambda: S.near("of", "and", "is", n=4)),
    ('NEAR("of and" with, 6)', lambda: S.near("of and", "with", n=6)),
    ('NEAR("of the" "and the" on, 9)', lambda: S.near("of the", "and the", "on", n=9)),
    ("^of", lambda: S.initial("of")),
    ('"!!!" OR von', lambda: S.term("!!!") | S.term("von")),
])
def test_document_hits_match_fts5(spark, docs, query, build):
    con = _fts(docs)
    want = sorted(r[0] for r in con.execute("select rowid from f where f match ?", (query,)))
    df = spark.createDataFrame(docs, "id long, message string").withColumn("terms", terms("message"))
    assert hits(df, build()) == want


def test_stem_drift_bound(docs):
    """The pre-filter relies on every token starting with its stem minus the
    last STEM_DRIFT characters."""
    vocab = {t for _, text in docs for t in tokenize_py(text)}
    vocab |= {"sensibility", "relational", "hopefulness", "vietnamization", "probability", "happy", "possibly"}
    assert all(t.startswith(S._root(stem(t))) for t in vocab)


def test_search_from_stored_postings(spark, tmp_dir):
    """Postings written by appends and kept by retention answer like the rows."""
    import os

    from logloom.operators.postings import search_postings
    from logloom.operators.query import LogQuery, apply_query
    from logloom.plans.fixtures import logs_from_events
    from logloom.sinks.retention import apply_retention
    from logloom.sinks.table import merge_postings, write_log_table
    from logloom.sources.logs import read_logs, read_postings

    table, post = os.path.join(tmp_dir, "logs"), os.path.join(tmp_dir, "postings")
    rows = logs_from_events(spark, SF_SMALL)
    for half in (0, 1):
        write_log_table(rows.where(F.col("id") % 2 == half), table, postings_path=post)
    matches = [S.term("cache"), S.prefix("sett"), S.phrase("write refused"), S.phrase("refused write"), S.initial("ledger"),
               S.term("cache") & S.term("lease"), S.term("within") - S.term("payment"), S.term("cache") & ~S.term("ledger"),
               S.Phrase(("ledger", "lo"), prefix=True), S.term("warmed") | S.phrase("its cache"), S.term("!!!"), S.term("8"),
               S.near("cache", "shard", n=3), S.near("shard", "cache", n=0), S.near("write refused", "by shard", n=0),
               S.near("settled", "within", "payment", n=2), S.near("cache", "cache"), S.near("ledger", "!!!"),
               S.near("cache", "lease") - S.near("lost", "lease", n=1)]
    cutoff = 1705320000 * 10**9
    for step in ("append", "merge", "retention", "merge again"):
        if step == "retention":
            assert apply_retention(spark, table, cutoff, os.path.join(tmp_dir, "stage"), postings_path=post) > 0
        elif step != "append":
            assert merge_postings(spark, table, post, os.path.join(tmp_dir, "stage"), files=2) > 0 or step == "merge again"
        logs, stored = read_logs(spark, table), read_postings(spark, post)
        assert stored.select("id").distinct().count() == logs.count()
        for m in matches:
            via = sorted(r.id for r in search_postings(logs, stored, m).select("id").collect())
            assert via == hits(logs, m)
    plan = search_postings(logs, stored, S.term("cache"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,cach)" in plan
    q = LogQuery(search="cache", start_ns=cutoff + 86_400 * 10**9)
    found = apply_query(logs, q, postings=stored)
    assert sorted(r.id for r in found.select("id").collect()) == sorted(r.id for r in apply_query(logs, q).select("id").collect())
