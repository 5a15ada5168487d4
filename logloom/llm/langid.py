"""Language identification with spans of mixed-language text.

A word is a run of letters (Unicode category L) of one script, with the marks
that follow them and apostrophes between them; anything else cuts.  Only
languages written in its script are candidates for a word.  Candidates score
the word by naive Bayes over hashed three-grams of its folded bytes and over
the word itself.  A Viterbi path over the words, with a penalty for switching
the language, labels the spans.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from logloom.llm.common import arrow_map, sample_by_hash
from logloom.llm.features import Laid, lay_out

BITS = 16
SWITCH = 12.0
TRAIN_ROWS = 6000
#: A language is a candidate for a script that at least this share of its
#: words is written in.
SCRIPT_SHARE = 0.02
UNDETERMINED = "und"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256))

#: Scripts by first code points of their ranges (fixed values): ranges that
#: hold letters of one script, in order.
SCRIPTS = ["none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "thai",
           "georgian", "hangul", "kana", "han", "other"]
RANGES = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0x20000, 0x3134F, "han"),
]
_EDGES = np.array([e for a, b, _ in RANGES for e in (a, b + 1)], np.int64)
_KINDS = np.array([SCRIPTS.index("other")] + [SCRIPTS.index(x) for _, _, s in RANGES for x in (s, "other")], np.int8)


@dataclass
class Model:
    """``grams``, ``whole``: log-likelihood per hash index and language,
    above the languages' mean; ``candidates``: per script, which languages."""

    langs: list[str]
    grams: np.ndarray
    whole: np.ndarray
    candidates: np.ndarray
    switch: float = SWITCH


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point: the script of a letter, -1 for a mark, 0 for others."""
    first = "".join(unicodedata.category(chr(p))[0] for p in range(0x110000)).encode()
    group = np.frombuffer(first, np.uint8)
    kind = _KINDS[np.searchsorted(_EDGES, np.arange(0x110000), side="right")]
    return np.where(group == ord("L"), kind, np.where(group == ord("M"), -1, 0)).astype(np.int8)


@dataclass
class Words(Laid):
    """Words are runs of letters; a blank is put in where the script changes
    inside a run.  ``kind``: script of the word that each byte is in;
    ``letter``: whether a letter starts at it; ``put_in``: places of the
    blanks put in."""

    kind: np.ndarray
    letter: np.ndarray
    put_in: np.ndarray

    def raw(self, at: np.ndarray) -> np.ndarray:
        """Places as they are without the blanks put in."""
        return at - np.searchsorted(self.put_in, at)


def _read(texts: pa.Array) -> Words:
    laid = lay_out(texts, _FOLD)
    data = laid.data
    kind = np.where((data >= 97) & (data <= 122), np.int8(SCRIPTS.index("latin")), np.int8(0))
    letter = kind > 0
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = [data[lead + k].astype(np.int64) for k in range(4)]
        size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        point = np.where(size == 2, (b[0] & 31) << 6 | (b[1] & 63), np.where(
            size == 3, (b[0] & 15) << 12 | (b[1] & 63) << 6 | (b[2] & 63),
            (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | (b[3] & 63)))
        whole = np.logical_and.reduce([(k >= size) | (b[k] & 0xC0 == 0x80) for k in (1, 2, 3)]) & (point < 0x110000)
        found = np.where(whole, _classes()[np.where(whole, point, 0)], 0).astype(np.int8)
        letter[lead] = found > 0
        for k in range(4):
            part = whole & (k < size)
            kind[lead[part] + k] = found[part]
        if (found < 0).any():  # marks belong to what is before them
            before = np.maximum.accumulate(np.where(kind >= 0, np.arange(len(kind)), 0))
            kind = kind[before]
    quote = np.flatnonzero(data == 39)
    inner = quote[(kind[quote - 1] > 0) & (kind[quote + 1] > 0)]
    kind[inner] = kind[inner - 1]
    data = np.where(kind > 0, data, np.uint8(32))
    cuts = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    if len(cuts):
        data, kind, letter = np.insert(data, cuts, 32), np.insert(kind, cuts, 0), np.insert(letter, cuts, False)
    return Words(data, laid.starts + np.searchsorted(cuts, laid.starts), laid.ends + np.searchsorted(cuts, laid.ends),
                 kind, letter, cuts + np.arange(len(cuts)))


def _indices(laid: Laid, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash index of the three bytes around each byte, and of each word."""
    grams = ((laid.fours & np.uint32(0xFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return grams, (laid.word_hashes >> np.uint64(64 - bits)).astype(np.int64)


def word_scores(laid: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(words x languages) evidence, and the script of each word."""
    bits = int(np.log2(len(model.grams)))
    grams, whole = _indices(laid, bits)
    start, end = laid.words
    kind = laid.kind[start]
    out = model.whole[whole].astype(np.float64)
    for k in range(len(model.langs)):
        total = np.zeros(len(laid.data) + 1)
        np.cumsum(model.grams[:, k][grams], out=total[2:len(grams) + 2])
        out[:, k] += total[end] - total[start]
    open_ = model.candidates[kind]
    some = open_.any(axis=1)
    out[~some] = 0.0
    return np.where(open_ | ~some[:, None], out, -50.0), kind


def viterbi(scores: np.ndarray, ranges: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word; text i has words ``ranges[i]:ranges[i+1]``.

    All texts advance together, longest first, one word a step.
    """
    n_words, n_langs = scores.shape
    path = np.zeros(n_words, np.int8)
    sizes = np.diff(ranges)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if len(order) == 0 or n_langs == 0:
        return path
    first, size = ranges[order], sizes[order]
    longest = int(size[0])
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    value = scores[first].copy()
    stay = np.ones((n_words, n_langs), bool)  # or: came from the best language before
    lead = np.zeros(n_words, np.int8)
    for t in range(1, longest):
        m = int(alive[t])
        value = value[:m]
        best = value.argmax(axis=1)
        top = value[np.arange(m), best]
        top -= switch
        at = first[:m] + t
        kept = value >= top[:, None]
        stay[at] = kept
        lead[at] = best
        value = np.where(kept, value, top[:, None])
        value -= (top + switch)[:, None]
        value += scores[at]
        ended = 0 if t + 1 == longest else int(alive[t + 1])
        if ended < m:
            path[first[ended:m] + t] = value[ended:].argmax(axis=1)
    single = first[size == 1]
    path[single] = scores[single].argmax(axis=1)
    if longest == 1:
        return path
    now = np.zeros(len(order), np.int64)
    for t in range(longest - 1, 0, -1):
        m = int(alive[t])
        at = first[:m] + t
        ends = size[:m] == t + 1
        now[:m] = np.where(ends, path[at], now[:m])
        path[at] = now[:m]
        now[:m] = np.where(stay[at, now[:m]], now[:m], lead[at])
    path[first] = np.where(size > 1, now, path[first])
    return path


def _label(texts: pa.Array, model: Model):
    """The words, their path, and per text the letters of each language."""
    laid = _read(texts)
    scores, _ = word_scores(laid, model)
    path = viterbi(scores, laid.word_range, model.switch)
    upto = np.concatenate([[0], np.cumsum(laid.letter, dtype=np.int32)])
    letters = upto[laid.words[1]] - upto[laid.words[0]]
    text_of = np.repeat(np.arange(len(texts)), np.diff(laid.word_range))
    share = np.zeros((len(texts), len(model.langs)))
    if model.langs:
        np.add.at(share, (text_of, path), letters)
    return laid, path, share


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row: the language with most letters on
    the path, and its share of the letters.  Null texts and texts without a
    letter: ``und`` and 0."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, share = _label(batch.column(1), model)
        total = share.sum(axis=1)
        best = share.argmax(axis=1) if share.shape[1] else np.zeros(len(total), int)
        known = total > 0
        names = [model.langs[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), known.tolist())]
        top = np.where(known, share.max(axis=1, initial=0), 0) / np.maximum(total, 1)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(top)],
                                          ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), run,
                     "doc_id bigint, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans ARRAY<STRUCT<start, end, lang>>) per row: runs of words
    of one language, as byte positions in the UTF-8 text; empty for texts
    without a letter."""
    kind_of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        laid, path, _ = _label(batch.column(1), model)
        start, end, base = laid.raw(laid.words[0]), laid.raw(laid.words[1]), laid.raw(laid.starts)
        out = []
        for i in range(batch.num_rows):
            words = np.arange(laid.word_range[i], laid.word_range[i + 1])
            words = words if model.langs else words[:0]
            cuts = np.flatnonzero(np.diff(path[words])) + 1 if len(words) else []
            out.append([{"start": int(start[w[0]] - base[i]), "end": int(end[w[-1]] - base[i]),
                         "lang": model.langs[path[w[0]]]} for w in np.split(words, cuts) if len(w)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind_of)], ["doc_id", "spans"])

    return arrow_map(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), run,
                     "doc_id bigint, spans array<struct<start:bigint,end:bigint,lang:string>>")


def train(docs: DataFrame, max_rows: int = TRAIN_ROWS, bits: int = BITS, smooth: float = 0.5) -> Model:
    """Learn from the ``max_rows`` rows of (doc_id, text, lang) whose doc_id
    hashes lowest; rows with a null in any of the three are left out, and of
    rows that share a doc_id one counts.  Without rows nothing is learned and
    every text is ``und``."""
    usable = docs.where("doc_id is not null and text is not null and lang is not null")
    picked = sample_by_hash(usable.groupBy("doc_id").agg(F.min("lang").alias("lang")), "doc_id", max_rows)
    rows = usable.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "lang").agg(
        F.min("text").alias("text")).select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = np.array(batch.column(0).to_pylist(), object)
        laid = _read(batch.column(1))
        grams, whole = _indices(laid, bits)
        kind = laid.kind[laid.words[0]]
        out = []
        for lang in sorted(set(names.tolist())):
            g, w, s = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), np.zeros(len(SCRIPTS), np.int64)
            for i in np.flatnonzero(names == lang):
                a, b = laid.word_range[i], laid.word_range[i + 1]
                inside = grams[laid.starts[i] - 1:laid.ends[i] - 1][laid.data[laid.starts[i]:laid.ends[i]] != 32]
                g += np.bincount(inside, minlength=1 << bits)
                w += np.bincount(whole[a:b], minlength=1 << bits)
                s += np.bincount(kind[a:b], minlength=len(SCRIPTS))
            out.append((lang, g.tobytes(), w.tobytes(), s.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string())] + [
            pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3)], ["lang", "grams", "words", "scripts"])

    total: dict[str, list[np.ndarray]] = {}
    for r in arrow_map(rows, count, "lang string, grams binary, words binary, scripts binary").toLocalIterator():
        own = [np.frombuffer(x, np.int64) for x in (r.grams, r.words, r.scripts)]
        total[r.lang] = [a + b for a, b in zip(total[r.lang], own)] if r.lang in total else own
    langs = sorted(total)
    size = 1 << bits
    if not langs:
        return Model([], np.zeros((size, 0), np.float32), np.zeros((size, 0), np.float32),
                     np.zeros((len(SCRIPTS), 0), bool))

    def table(which: int) -> np.ndarray:
        counts = np.stack([total[k][which] for k in langs], axis=1).astype(float)
        seen = counts.sum(axis=1, keepdims=True) > 0
        logs = np.log(counts + smooth) - np.log(counts.sum(axis=0, keepdims=True) + smooth * size)
        return np.where(seen, logs - logs.mean(axis=1, keepdims=True), 0.0).astype(np.float32)

    scripts = np.stack([total[k][2] for k in langs], axis=1).astype(float)
    scripts[0] = 0
    candidates = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    return Model(langs, table(0), table(1), candidates)
