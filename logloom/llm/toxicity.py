"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, accents and width forms to base letters,
look-alike letters of other scripts and digit or sign substitutions to Latin
letters, invisible characters out, everything else to single blanks.  Lexicon
entries are word beginnings, so inflected forms count; a hit that lies inside
an exception phrase does not.  The weighted hits, alone and by text length,
go through a logistic curve.

Entries, weights, exceptions and the curve are learned from labelled texts.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from logloom.llm.common import arrow_map, code_points, cut, sample_by_hash

#: Letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "ս": "u", "α": "a", "β": "b",
    "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l",
    "ø": "o", "đ": "d",
}
#: Digits that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: Signs that stand for letters where a letter follows.
SIGNS = {"@": "a", "$": "s", "!": "i"}
_BLANK, _GONE = 32, 0
#: Word beginnings that are looked at, in letters.
PREFIX = (3, 12)
TRAIN_ROWS = 6000


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """What each code point below 0x20000 is folded to (blank, gone or a letter)."""
    table = np.full(0x20000, _BLANK, np.uint32)
    for point in range(1, len(table)):
        char = chr(point)
        kind = unicodedata.category(char)
        if kind in ("Mn", "Cf", "Me"):
            table[point] = _GONE
        elif kind[0] == "L" or char in DIGITS or kind == "Nd":
            base = unicodedata.normalize("NFKD", char)[0].lower()[0]
            base = LOOKALIKES.get(base, DIGITS.get(base, base))
            if unicodedata.category(base)[0] == "L":
                table[point] = ord(base)
    return table


def fold(col: pa.Array) -> list[str]:
    """Folded texts; each starts and ends with a blank, words one blank apart."""
    points, off = code_points(col)
    framed = np.full(len(points) + 2 * len(off) - 2, _BLANK, np.uint32)
    starts = off[:-1] + 2 * np.arange(len(off) - 1)
    if len(points):
        framed[np.arange(len(points)) + 1 + 2 * np.repeat(np.arange(len(off) - 1), np.diff(off))] = points
    table = _fold_table()
    out = table[np.minimum(framed, len(table) - 1)]
    for sign, letter in SIGNS.items():
        at = np.flatnonzero(framed == ord(sign))
        while len(at := at[out[np.minimum(at + 1, len(out) - 1)] > 64]):  # the last of a run first
            out[at] = ord(letter)
            at = at - 1
            at = at[framed[at] == ord(sign)]
    kept = out != _GONE
    out = out[kept]
    before = np.concatenate([[0], np.cumsum(kept)])
    edges = np.append(before[starts], len(out))
    twice = np.zeros(len(out), bool)
    twice[1:] = (out[1:] == _BLANK) & (out[:-1] == _BLANK)
    twice[edges[:-1]] = False
    text = out[~twice].tobytes().decode("utf-32-le")
    gone = np.concatenate([[0], np.cumsum(twice)])
    edges = (edges - gone[edges]).tolist()
    return [text[a:b] if text[b - 1:b] == " " else text[a:b] + " " for a, b in zip(edges[:-1], edges[1:])]


@dataclass
class Lexicon:
    """``weights``: word beginnings to weights; ``exceptions``: phrases of
    whole words, all folded; ``curve``: factors of log(1 + hits),
    log(1 + hits per 1000 words), and the constant."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (1.0, 1.0, -3.0)

    def automaton(self) -> ahocorasick.Automaton:
        auto = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            auto.add_word(" " + word, (len(word) + 1, weight))
        for phrase in self.exceptions:
            key = f" {phrase} "
            if auto.get(key, None) is None:
                auto.add_word(key, (len(key), None))
        auto.make_automaton()
        return auto


def hits(auto: ahocorasick.Automaton, text: str) -> float:
    """Weight of all hits outside exception phrases."""
    found, safe = [], []
    for end, (length, weight) in auto.iter(text):
        (safe if weight is None else found).append((end - length + 1, end, weight))
    if not safe:
        return sum(w for _, _, w in found)
    # one pass in order of starts: a phrase that began before a hit and reaches its end covers it
    safe.sort(key=lambda s: s[0])
    total, reach, k = 0.0, -1, 0
    for a, b, w in sorted(found, key=lambda h: h[0]):
        while k < len(safe) and safe[k][0] <= a:
            reach, k = max(reach, safe[k][1]), k + 1
        if b > reach:
            total += w
    return total


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Length-normalised: hits per thousand words, short texts as if of 20 words."""
    return np.stack([np.log1p(weight), np.log1p(1000 * weight / np.maximum(words, 20)), np.ones(len(words))], axis=1)


def _scores(lexicon: Lexicon, auto, texts: list[str]) -> np.ndarray:
    weight = np.array([hits(auto, t) if len(lexicon.weights) else 0.0 for t in texts])
    words = np.array([t.count(" ") - 1 for t in texts], float)
    z = _features(np.maximum(weight, 0), words) @ np.array(lexicon.curve)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) per row: 0 to 1, higher: toxic likelier.  Whole texts;
    null and empty ones have no hit."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = _scores(lexicon, _automaton(lexicon), fold(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run,
                     "doc_id bigint, score double")


_BUILT: list = []


def _automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    """The lexicon's automaton, built once per worker."""
    if not _BUILT or _BUILT[0] != lexicon:
        _BUILT[:] = [lexicon, lexicon.automaton()]
    return _BUILT[1]


# ---------------------------------------------------------------- learning

def _prefixes(word: str) -> list[str]:
    return [word[:k] for k in range(PREFIX[0], min(PREFIX[1], len(word)) + 1)]


def _gain(tox: np.ndarray, clean: np.ndarray, n_tox: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of two rates: events of the classes in n texts or words."""
    both = (tox + clean) / (n_tox + n_clean)

    def part(k, n):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n * both, 1e-9)), 0.0)

    return 2 * (part(tox, max(n_tox, 1)) + part(clean, max(n_clean, 1)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = TRAIN_ROWS,
          min_texts: int = 4, min_gain: float = 20.0) -> Lexicon:
    """Learn a lexicon from the documents whose ``labels`` row is among the
    ``max_rows`` lowest by hash of doc_id.

    An entry occurs in at least ``min_texts`` toxic texts, its rates per text
    and per word both tell the classes apart by a log-likelihood ratio of
    ``min_gain``, and it is the best of the beginnings that extend each other.  Its weight is the log ratio of its
    rates per word.  A pair of words around a hit that occurs in twice as
    many clean texts and in no toxic one is an exception.  Without toxic or
    without clean texts the lexicon is empty.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("label"))
    marked = sample_by_hash(marked, "doc_id", max_rows)  # bounded by max_rows: safe to broadcast
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").groupBy("doc_id", "label").agg(
        F.min("text").alias("text")).select("label", "text"))

    def starts(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = Counter()
        for text in fold(batch.column(1)):
            seen.update({p for w in set(text.split()) for p in _prefixes(w)})
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                          ["entry", "texts"])

    table = (arrow_map(rows.where("label = 1"), starts, "entry string, texts bigint").groupBy("entry")
             .agg(F.sum("texts").alias("texts")).where(F.col("texts") >= min_texts).orderBy("entry").toArrow())
    entries = table.column(0).to_pylist()
    if not entries:
        return Lexicon({}, [], (0.0, 0.0, _base(rows)))
    auto = Lexicon(dict.fromkeys(entries, 1.0)).automaton()
    index = {e: i for i, e in enumerate(entries)}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        label = np.array(batch.column(0).to_pylist())
        got = {v: [np.zeros(len(entries), np.int64), np.zeros(len(entries), np.int64), 0, 0] for v in (0, 1)}
        for v, text in zip(label, fold(batch.column(1))):
            of = Counter(index[text[end - n + 2:end + 1]] for end, (n, _) in auto.iter(text))
            at = np.fromiter(of, np.int64, len(of))
            got[v][0][at] += 1
            got[v][1][at] += np.fromiter(of.values(), np.int64, len(of))
            got[v][2] += 1
            got[v][3] += text.count(" ") - 1
        keys = [v for v in (0, 1) if got[v][2]]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32())] + [
            pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in (got[v][k] for v in keys)], t)
            for k, t in ((0, pa.binary()), (1, pa.binary()), (2, pa.int64()), (3, pa.int64()))],
            ["label", "texts", "times", "n", "words"])

    sums = {v: [np.zeros(len(entries)), np.zeros(len(entries)), 0, 0] for v in (0, 1)}
    for r in arrow_map(rows, count, "label int, texts binary, times binary, n bigint, words bigint").toLocalIterator():
        s = sums[r.label]
        s[0] += np.frombuffer(r.texts, np.int64)
        s[1] += np.frombuffer(r.times, np.int64)
        s[2] += r.n
        s[3] += r.words
    (clean, clean_times, n_clean, clean_words), (tox, tox_times, n_tox, tox_words) = sums[0], sums[1]
    if not n_clean or not n_tox:
        return Lexicon({}, [], (0.0, 0.0, _base(rows)))
    gain = _gain(tox_times, clean_times, tox_words, clean_words)
    weight = np.log((tox_times + 0.5) / (tox_words + 1)) - np.log((clean_times + 0.5) / (clean_words + 1))
    gain[(weight <= 0) | (tox * n_clean <= clean * n_tox) | (_gain(tox, clean, n_tox, n_clean) < min_gain)] = 0
    weights: dict[str, float] = {}
    for i in np.argsort(-gain, kind="stable"):
        if gain[i] < min_gain:
            break
        if not any(entries[i].startswith(e) or e.startswith(entries[i]) for e in weights):
            # as good and longer: the more exact beginning
            best = max((k for k in index.values() if entries[k].startswith(entries[i]) and gain[k] >= 0.95 * gain[i]),
                       key=lambda k: len(entries[k]))
            weights[entries[best]] = float(weight[best])
    if not weights:
        return Lexicon({}, [], (0.0, 0.0, _base(rows)))
    lexicon = Lexicon(weights)
    lexicon.exceptions = _exceptions(rows, lexicon, 2 * min_texts)
    lexicon.curve = _curve(rows, lexicon)
    return lexicon


def _base(rows: DataFrame) -> float:
    share = rows.agg(F.avg("label")).first()[0]
    share = 0.0 if share is None else float(share)
    return float(np.log((share + 1e-3) / (1 - share + 1e-3)))


def _exceptions(rows: DataFrame, lexicon: Lexicon, min_texts: int) -> list[str]:
    auto = lexicon.automaton()

    def around(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = Counter()
        for v, text in zip(batch.column(0).to_pylist(), fold(batch.column(1))):
            of = set()
            for end, (n, _) in auto.iter(text):
                a, b = end - n + 2, text.index(" ", end)
                left = text.rfind(" ", 0, a - 1)
                right = text.find(" ", b + 1)
                of.add((text[left + 1:b], v))
                if right > 0:
                    of.add((text[a:right], v))
            seen.update(x for x in of if " " in x[0])
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()),
                                           pa.array([k[1] for k in keys], pa.int32()),
                                           pa.array([seen[k] for k in keys], pa.int64())], ["phrase", "label", "texts"])

    pairs = arrow_map(rows, around, "phrase string, label int, texts bigint").groupBy("phrase").agg(
        F.sum(F.expr("if(label = 1, texts, 0)")).alias("tox"), F.sum(F.expr("if(label = 0, texts, 0)")).alias("clean"))
    return sorted(r.phrase for r in pairs.where((F.col("tox") == 0) & (F.col("clean") >= min_texts)).toLocalIterator())


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression of the label on the length-normalised hits."""
    auto = lexicon.automaton()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = fold(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([hits(auto, t) for t in texts], pa.float64()),
                                           pa.array([t.count(" ") - 1 for t in texts], pa.int64())],
                                          ["label", "weight", "words"])

    got = arrow_map(rows, run, "label int, weight double, words bigint").toArrow().sort_by(
        [(c, "ascending") for c in ("weight", "words", "label")])  # bounded by the sample
    y, weight, words = (got.column(k).to_numpy().astype(float) for k in range(3))
    x = _features(np.maximum(weight, 0), words)
    curve = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        grad = x.T @ (p - y) + np.array([0.05, 0.05, 0]) * curve
        hess = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag([0.05, 0.05, 1e-6])
        step = np.linalg.solve(hess, grad)
        curve -= step * min(1.0, 5 / max(abs(step).max(), 1e-9))
        if abs(step).max() < 1e-7:
            break
    return tuple(float(v) for v in curve)
