"""Classifiers and language identification: held-out accuracy, odd rows."""

import itertools

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import langid, nbsvm, queries, toxicity
from logloom.llm.common import crc_mod, table
from logloom.llm.features import indicators
from samples import ODD, clashing, docs, empty, labels, odd  # noqa: F401 - fixtures

MID = "/root/testdata/sf0.01"


def test_crc_split(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"))
    assert all(r.m == brute.crc(r.doc_id, 5) for r in df.withColumn("m", crc_mod("doc_id", 5)).collect())


# -------------------------------------------------------- quality (op 7)

def test_quality_held_out(spark):
    got = queries.QUERIES["op7_quality_classifier"](spark, MID).join(table(spark, MID, "labels"), "doc_id")
    rows = [r for r in got.collect() if r.held_out]
    assert len(rows) > 50 and all(brute.crc(r.doc_id, 5) == 0 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_odd_rows(spark, odd, clashing, empty, docs, labels):
    model = nbsvm.train(docs, labels, "quality", max_rows=150)
    got = nbsvm.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r, (_, text, *_) in zip(got, ODD):
        by_text.setdefault(text or "", set()).add(r.score)
    assert all(len(v) == 1 for v in by_text.values())
    kept = nbsvm.keep(clashing, model, threshold=0.0)
    assert kept.columns == clashing.columns and kept.count() == len(ODD)
    assert nbsvm.score(empty, model).count() == 0
    mixed = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, None), (1, 0, 0), (2, 7, 7)], labels.schema))
    again = nbsvm.train(docs, mixed, "quality", max_rows=150)
    assert again.weights.shape == model.weights.shape


def test_quality_without_rows_of_both_classes(empty, docs, labels):
    for rows in (labels.where("false"), labels.where("quality = 1")):
        model = nbsvm.train(docs, rows, "quality")
        assert len(set(r.score for r in nbsvm.score(docs, model).collect())) == 1
    assert nbsvm.train(empty, labels, "quality").scores([np.zeros(0, int)])[0] == pytest.approx(0.5)


def test_quality_is_fitted_outside_the_driver(docs, labels, monkeypatch):
    marked = {r.doc_id: r.label for r in labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("label")).collect()}
    texts = {}
    for r in docs.where(F.col("doc_id").isin(list(marked))).collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    ids = sorted(texts)
    least = pa.array([min((t for t in texts[i] if t is not None), default=None) for i in ids], pa.string())
    plain = nbsvm.fit(indicators(least), np.array([1 if marked[i] else -1 for i in ids]))
    came = []
    bring = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: came.append(bring(df)) or came[-1])
    model = nbsvm.train(docs, labels, "quality")
    assert np.allclose(model.weights, plain.weights) and np.allclose(model.ratios, plain.ratios)
    assert np.allclose([model.bias, model.slope, model.shift], [plain.bias, plain.slope, plain.shift])
    assert len(ids) > 50 and sum(t.num_rows for t in came) == 1  # the model, not the rows it is fitted on


def test_hinge_dual_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(30, rng.integers(1, 8), replace=False)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.4, 1, -1)
    values = [rng.normal(size=len(r)) for r in rows]
    w, b = nbsvm.hinge_dual(rows, values, y, 30, 0.5, 3000)
    share = {s: (y == s).sum() for s in (-1, 1)}

    def loss(w, b):
        hinge = sum(0.5 * len(y) / (2 * share[s]) * max(0, 1 - s * (w[r] @ v + b)) for r, v, s in zip(rows, values, y))
        return 0.5 * (w @ w + b * b) + hinge

    best = loss(w, b)
    for _ in range(300):
        assert best <= loss(w + rng.normal(size=30) * 0.02, b + rng.normal() * 0.02) + 1e-3


def test_indicators_match_a_plain_count():
    texts = ["ab ab ab cd", "", None, "x", "é é\tz\n\nlonger words here"]
    both = indicators(pa.array(texts, pa.string()), 18)
    alone = [indicators(pa.array([t], pa.string()), 18)[0] for t in texts]
    for a, b in zip(both, alone):
        assert sorted(a.tolist()) == sorted(b.tolist()) and len(set(a.tolist())) == len(a)
    assert len(both[1]) == len(both[2]) == 0


# ------------------------------------------------------- toxicity (op 10)

def test_toxicity_held_out(spark):
    got = queries.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").join(
        table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.02
    assert all(brute.crc(r.doc_id, 4) == 2 for r in got)


def test_folding_and_exceptions():
    texts = pa.array(["1d10t $tup1d! ѕсum ïdïot ｃｌｏｗｎ x​y", None, "", "!!! $$$", "A-B\n\nc"])
    assert toxicity.fold(texts) == [" idiot stupid scum idiot clown xy ", " ", " ", " ", " a b c "]
    assert toxicity.fold(texts.slice(0, 0)) == []
    lexicon = toxicity.Lexicon({"clown": 2.0, "scum": 1.0}, ["clown fish"])
    auto = lexicon.automaton()
    each = [toxicity.hits(auto, t) for t in toxicity.fold(pa.array(
        ["a clown", "CLOWN fish", "clown fishes", "clowns, scum", "subscum", "clown fish clown"]))]
    assert each == [2.0, 0, 2.0, 3.0, 0, 2.0]


def test_toxicity_odd_rows(spark, odd, empty, docs, labels):
    for lexicon in (toxicity.Lexicon({"idiot": 5.0}), toxicity.train(docs, labels),
                    toxicity.train(docs, labels.where("toxic = 0")), toxicity.train(empty, labels)):
        got = toxicity.score(odd, lexicon).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score(empty, lexicon).count() == 0


# ------------------------------------------------------- language (op 6)

def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        sizes = rng.integers(0, 6, rng.integers(1, 6))
        at = np.concatenate([[0], np.cumsum(sizes)])
        scores = rng.normal(size=(at[-1], 3)) * 3
        path = langid.viterbi(scores, at, 2.0)
        for a, b in zip(at[:-1], at[1:]):
            def value(p):
                return sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
            if b > a:
                best = max(value(p) for p in itertools.product(range(3), repeat=b - a))
                assert abs(best - value(path[a:b])) < 1e-9


def test_language_held_out(spark):
    got = queries.QUERIES["op6_language_id"](spark, MID).join(table(spark, MID, "documents"), "doc_id")
    rows = [r for r in got.collect() if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 and brute.crc(r.doc_id, 3) == 1 for r in rows)


def test_language_spans_and_scripts(spark):
    texts = {"en": "the cat sat on the mat and the dog ran to the house with the ball",
             "de": "der hund und die katze sind nicht in dem haus mit dem ball und der maus",
             "el": "το σπίτι είναι μεγάλο και η γάτα είναι μικρή στο δρόμο",
             "ru": "дом большой и кошка маленькая на улице у нас есть собака"}
    rows = [(k, " ".join([t] * 3), lang) for k, (lang, t) in enumerate(itertools.chain(*[texts.items()] * 4))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["de", "el", "en", "ru"]
    greek, latin = langid.SCRIPTS.index("greek"), langid.SCRIPTS.index("latin")
    assert model.candidates[greek].tolist() == [False, True, False, False]
    assert model.candidates[latin].tolist() == [True, False, True, False]
    mixed = f"{texts['en']}. {texts['de']}! {texts['ru']} 123 {texts['en']}"
    probe = spark.createDataFrame([(1, mixed), (2, "42 -- !"), (3, None), (4, ""), (None, "die katze"), (6, "漢字 אבג")],
                                  "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in langid.spans(probe, model).collect()}
    raw = mixed.encode()
    assert [(s.lang, raw[s.start:s.end].decode()) for s in spans[1]] == [
        ("en", texts["en"]), ("de", texts["de"]), ("ru", texts["ru"]), ("en", texts["en"])]
    assert spans[2] == spans[3] == spans[4] == []
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.detect(probe, model).collect()}
    assert got[1][0] == "en" and got[2] == got[3] == got[4] == ("und", 0.0) and got[None][0] == "de"


def test_language_words_are_letters_of_one_script(spark):
    def words(text):
        laid = langid._read(pa.array(["x y", text, None]))
        a, b = laid.word_range[1:3]
        at = zip(laid.raw(laid.words[0][a:b]) - laid.raw(laid.starts)[1], laid.raw(laid.words[1][a:b]) - laid.raw(laid.starts)[1])
        return [(text.encode()[i:j].decode(), langid.SCRIPTS[k]) for (i, j), k in zip(at, laid.kind[laid.words[0][a:b]])]

    assert words("¿Qué? «Bonjour» “Hello” —hola\u00a0 ''tis'") == [
        ("Qué", "latin"), ("Bonjour", "latin"), ("Hello", "latin"), ("hola", "latin"), ("tis", "latin")]
    assert words("「漢字」かなdon't-мир…e\u0301te\u0301") == [
        ("漢字", "han"), ("かな", "kana"), ("don't", "latin"), ("мир", "cyrillic"), ("e\u0301te\u0301", "latin")]
    assert words("हिन्दी 5 ×") == [("हिन्दी", "devanagari")]
    assert words("😀👍🏽 ！？ ٣٤٥ ½ ' \u0301") == []
    broken = pa.array([b"a\xc3 b\xf0\x9f\x98 \xa9c", b"\xff\xff\xff\xff", b"\xc3"], pa.binary())
    laid = langid._read(pa.Array.from_buffers(pa.string(), 3, broken.buffers()))
    assert laid.letter.sum() == 3 and np.diff(laid.word_range).tolist() == [3, 0, 0]

    texts = {"es": "¿qué? hola", "fr": "«bonjour» monsieur", "en": "“hello” friend", "zh": "「漢字」你好"}
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(itertools.chain(*[texts.items()] * 4))],
                                 "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    probe = ["¿Qué?", "«Bonjour»", "“Hello", "\u00a0hola", "「漢字」", "😀 👍🏽", "٣٤٥", "！？", "「漢字，你好漢字」hello"]
    got = langid.detect(spark.createDataFrame(enumerate(probe), "doc_id bigint, text string"), model)
    assert [(r.lang_pred, r.score) for r in sorted(got.collect())] == [
        ("es", 1.0), ("fr", 1.0), ("en", 1.0), ("es", 1.0), ("zh", 1.0), ("und", 0.0), ("und", 0.0), ("und", 0.0),
        ("zh", 6 / 11)]
    last = langid.spans(spark.createDataFrame([(1, probe[-1])], "doc_id bigint, text string"), model.__class__(
        **{**vars(model), "switch": 0.0})).collect()[0].spans
    raw = probe[-1].encode()
    assert [(s.lang, raw[s.start:s.end].decode()) for s in last] == [("zh", "漢字，你好漢字"), ("en", "hello")]


def test_language_odd_rows(odd, empty, docs):
    model = langid.train(docs)
    assert len(langid.detect(odd, model).collect()) == len(ODD)
    assert langid.detect(empty, model).count() == 0
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.detect(odd, nothing).collect()} == {"und"}
    assert {tuple(r.spans) for r in langid.spans(odd.limit(3), nothing).collect()} == {()}
