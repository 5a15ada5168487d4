"""Ops 6, 7 and 10 over whole tables against plain scorers: the same learned
model, everything else text by text, word by word and byte by byte."""

import math
import unicodedata
from collections import Counter

import brute
import numpy as np
import pytest

from logloom.llm import langid, nbsvm, queries, toxicity
from logloom.llm.common import crc_mod, table
from samples import ODD, SF, docs, labels, odd  # noqa: F401 - fixtures

FULL = (1 << 64) - 1
STRANGE = ["same same same word word x", "\x1f\x7f a\tb", "ünï cödé — “quoted” don't 'tis", "мир hello漢字かなworld été",
           "1d10t $tup1d!! @$$ !!x", "a" * 5000, "ſ ｆｕｌｌ ² ٣ ½ ​ x​y", "''a''b' ' c'"]


def mix(x):
    x = x * 0x9E3779B97F4A7C15 & FULL
    return (x ^ x >> 32) * 0xD6E8FEB86659FD93 & FULL


def threes(word):
    """The three bytes around each byte of a word that stands between blanks."""
    framed = b" " + word + b" "
    return [framed[i] | framed[i + 1] << 8 | framed[i + 2] << 16 for i in range(len(word))]


def gram(x, bits):
    return (x * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - bits


def word_hash(word):
    return mix(sum(map(mix, threes(word))) & FULL)


def logistic(z):
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def both(odd, docs):
    """The table of the smallest scale, odd rows, and strange texts."""
    strange = odd.sparkSession.createDataFrame([(900 + k, t) for k, t in enumerate(STRANGE)], "doc_id bigint, text string")
    return docs.select("doc_id", "text").unionAll(odd.select("doc_id", "text")).unionAll(strange)


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert g[:-1] == w[:-1] and g[-1] == pytest.approx(w[-1], abs=1e-9)


def of_query(name, spark, docs, scorer, sf=SF):
    """A registered query's rows, each with what a scorer of its text gives."""
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = scorer(r.text)
        assert got[r.doc_id].score == pytest.approx(want[-1], abs=1e-9)
        yield got[r.doc_id], want


# -------------------------------------------------------------------- op 7

def quality(model, text):
    raw = bytes(32 if c <= 32 else c for c in (text or "").encode())
    words = [w for w in raw.split(b" ") if w]
    found = {gram(x, model.bits) for x in threes(raw)}
    hashes = [word_hash(w) for w in words]
    found |= {h >> 64 - model.bits for h in hashes}
    found |= {mix(a * 3 + b & FULL) >> 64 - model.bits for a, b in zip(hashes, hashes[1:])}
    marks = [int(a == b) for a, b in zip(hashes, hashes[1:])]
    if any(marks):
        for n in range(2, 7):
            for i in range(len(marks) - n + 1):
                code = int(str(1) + "".join(map(str, marks[i:i + n])), 2) + (n - 1 << n) + (1 << 40)
                found.add(mix(code) >> 64 - model.bits)
    margin = model.bias
    if found:
        margin += sum(model.weights[i] for i in found) / math.sqrt(max(sum(model.ratios[i] ** 2 for i in found), 1e-12))
    return (logistic(model.slope * margin + model.shift),)


def test_quality_scores(spark, docs, labels, odd):
    model = nbsvm.train(docs, labels.where(crc_mod("doc_id", 5) != 0), "quality")
    for r, (score,) in of_query("op7_quality_classifier", spark, docs, lambda t: quality(model, t)):
        assert r.held_out == (brute.crc(r.doc_id, 5) == 0) and r.predicted == int(score >= 0.3)
    rows = both(odd, docs)
    close([tuple(r) for r in nbsvm.score(rows, model).collect()], [(r.doc_id, *quality(model, r.text)) for r in rows.collect()])


# ------------------------------------------------------------------- op 10

def folded(text):
    out = []
    for char in f" {text or ''} ":
        kind = unicodedata.category(char)
        if ord(char) and kind in ("Mn", "Cf", "Me"):
            out.append("")
        elif ord(char) < 0x1FFFF and (kind[0] == "L" or kind == "Nd"):
            base = unicodedata.normalize("NFKD", char)[0].lower()[0]
            base = toxicity.LOOKALIKES.get(base, toxicity.DIGITS.get(base, base))
            out.append(base if unicodedata.category(base)[0] == "L" else " ")
        else:
            out.append(" ")
    framed = f" {text or ''} "
    for i in range(len(framed) - 2, -1, -1):
        if framed[i] in toxicity.SIGNS and out[i + 1] > "@":
            out[i] = toxicity.SIGNS[framed[i]]
    return " " + "".join(f"{w} " for w in "".join(out).split(" ") if w)


def places(text, part):
    at, out = text.find(part), []
    while at >= 0:
        out.append((at, at + len(part)))
        at = text.find(part, at + 1)
    return out


def toxic(lexicon, text):
    text = folded(text)
    safe = [p for phrase in lexicon.exceptions for p in places(text, f" {phrase} ")]
    weight = sum(w for word, w in lexicon.weights.items() for a, b in places(text, " " + word)
                 if not any(c <= a and b <= d for c, d in safe))
    weight, n = max(weight, 0), max(text.count(" ") - 1, 20)
    a, b, c = lexicon.curve
    return (logistic(a * math.log1p(weight) + b * math.log1p(1000 * weight / n) + c),)


def test_toxic_scores(spark, docs, odd):
    for sf in (SF, "/root/testdata/sf0.01"):  # the smaller one has too few toxic texts for any entry
        whole, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
        lexicon = toxicity.train(whole, marks.where(crc_mod("doc_id", 4) != 2), "toxic")
        for r, (score,) in of_query("op10_toxicity", spark, whole, lambda t: toxic(lexicon, t), sf):
            assert r.held_out == (brute.crc(r.doc_id, 4) == 2) and r.predicted == int(score >= 0.3)
    assert lexicon.weights
    own = toxicity.Lexicon({"idiot": 2.0, "word": 0.5, "stup": 1.0, "as": 0.25}, ["one two three", "word word"])
    rows = both(odd, docs)
    for lex in (lexicon, own):
        close([tuple(r) for r in toxicity.score(rows, lex).collect()],
              [(r.doc_id, *toxic(lex, r.text)) for r in rows.collect()])


# -------------------------------------------------------------------- op 6

def language(model, text):
    classes, text = langid._classes(), text or ""
    kinds = []  # script of each character; marks belong to what is before them
    for char in text:
        kind = int(classes[ord(char)])
        kinds.append(kind if kind >= 0 else kinds[-1] if kinds else 0)
    plain = [0, *kinds, 0]
    for i, char in enumerate(text):
        if char == "'" and plain[i] and plain[i + 2]:
            kinds[i] = plain[i]
    words = []  # (script, bytes, letters)
    for i, (char, kind) in enumerate(zip(text, kinds)):
        if not kind:
            continue
        low = char.lower() if char.isascii() else char
        letter = int(classes[ord(char)] > 0)
        if i and kinds[i - 1] == kind:
            _, done, n = words[-1]
            words[-1] = (kind, done + low.encode(), n + letter)
        else:
            words.append((kind, low.encode(), letter))
    bits = len(model.grams).bit_length() - 1
    value, back = None, []
    for kind, word, _ in words:
        own = model.whole[word_hash(word) >> 64 - bits].astype(float)
        own = own + sum(model.grams[gram(x, bits)].astype(float) for x in threes(word))
        open_ = model.candidates[kind]
        own = np.where(open_, own, -50.0) if open_.any() else np.zeros(len(own))
        if value is None:
            value = own
            continue
        best = int(value.argmax())
        back.append([k if value[k] >= value[best] - model.switch else best for k in range(len(own))])
        value = np.maximum(value, value[best] - model.switch) + own
    if not sum(n for _, _, n in words):
        return ("und", 0.0)
    path = [int(value.argmax())]
    for step in reversed(back):
        path.append(step[path[-1]])
    share = Counter()
    for lang, (_, _, n) in zip(reversed(path), words):
        share[lang] += n
    best = max(sorted(share), key=lambda k: share[k])
    return (model.langs[best], share[best] / sum(share.values()))


def test_languages(spark, docs, odd):
    model = langid.train(docs.where(crc_mod("doc_id", 3) != 1).where("lang is not null"))
    for r, (lang, _) in of_query("op6_language_id", spark, docs, lambda t: language(model, t)):
        assert r.held_out == (brute.crc(r.doc_id, 3) == 1) and r.lang_pred == lang
    rows = both(odd, docs)
    close([tuple(r) for r in langid.detect(rows, model).collect()],
          [(r.doc_id, *language(model, r.text)) for r in rows.collect()])
