"""Personal data: e-mail addresses, IP addresses, card and phone numbers.

Base spans come from fixed patterns and checks.  They cannot separate what
runs together: two card numbers with a blank between them are one match of 32
digits, which fails.  A character-level bidirectional LSTM with CRF
transitions, trained in numpy on base spans of the corpus, adds such spans;
every span it adds has to pass the checks of its kind, and base spans stay.

The network reads windows of ``WINDOW`` characters that overlap by half.  They
cover every place where a span can be: an ``@`` with the characters around it
up to blanks, and runs of at least four digits no more than three characters
apart, each with some context (no accepted span lies elsewhere).  Windows are
decoded by Viterbi; over a whole text, every character takes the tag of the
window in which it lies farthest from the edges, and spans are put together
from these tags, so a span may be longer than a window.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window, functions as F

from logloom.llm.common import arrow_map, code_points

KINDS = ["email", "ip", "card", "phone"]
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: A match that begins inside digits would also begin before them.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Tags: 0 outside, 1 + 2 k first and 2 + 2 k further character of kind k.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE, CONTEXT = 64, 32, 20
#: Labelled spans of each kind that the network is trained on, and about how
#: many documents they are looked for in.
TRAIN_SPANS, TRAIN_DOCS = 400, 200_000
_FORBIDDEN = -1e4


# ------------------------------------------------------------- base spans

def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def accepts(kind: int, text: str) -> bool:
    """The checks of a kind on a matched text."""
    if kind == 0:
        return True
    if kind == 1:
        return all(int(p.lstrip("0")[:4] or 0) <= 255 for p in text.split("."))
    found = _digits(text)
    return 16 <= len(found) <= 19 and luhn(found) if kind == 2 else 8 <= len(found) <= 15


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(_LOCAL))
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield found
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start.  Linear in the
    text."""
    found = [(0, m) for m in _emails(text)]
    found += [(1, m) for m in _IP.finditer(text)] + [(2, m) for m in _CARD.finditer(text)]
    if "+" in text:
        found += [(3, m) for m in _PHONE.finditer(text)]
    return [(k, *m.span()) for k, m in found if accepts(k, m.group())]


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# ---------------------------------------------------------------- network

def _classes() -> np.ndarray:
    """Class of each code point below 128: digits, small and capital letters
    are one class each, every other printable character is its own."""
    out = np.full(128, 1)
    others = [c for c in range(32, 127) if not chr(c).isalnum()]
    out[others] = np.arange(len(others)) + 7
    out[[9, 10, 11, 12, 13]] = 2
    out[48:58], out[97:123], out[65:91] = 3, 4, 5
    return out


_CLASS = _classes()
#: 0: outside of the text, 6: not ASCII.
CLASSES = int(_CLASS.max()) + 1


def classes_of(points: np.ndarray) -> np.ndarray:
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], 6).astype(np.int64)


@dataclass
class Tagger:
    """Weights of both directions: ``w`` (2, classes, 4 h) input, ``r``
    (2, h, 4 h) recurrent, gates in the order in, forget, out, new; ``u``
    (2 h, tags) and ``b`` emissions; ``a`` (tags, tags) transitions, ``s``
    start scores."""

    w: np.ndarray
    r: np.ndarray
    u: np.ndarray
    b: np.ndarray
    a: np.ndarray
    s: np.ndarray

    NAMES = ("w", "r", "u", "b", "a", "s")

    @classmethod
    def fresh(cls, hidden: int, seed: int) -> "Tagger":
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
        out = cls(draw(2, CLASSES, 4 * hidden), draw(2, hidden, 4 * hidden), draw(2 * hidden, TAGS),
                  np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32))
        out.w[:, :, hidden:2 * hidden] += 1  # remember at first
        return out

    def states(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (T, B, 2 h) of class numbers ``x`` (T, B), and what
        the way back needs."""
        steps, n = x.shape
        h = self.r.shape[1]
        into = np.stack([self.w[0][x], self.w[1][x[::-1]]], axis=1)  # (T, 2, B, 4h)
        into[..., :3 * h] *= 0.5
        rec = self.r.copy()
        rec[..., :3 * h] *= 0.5
        hidden = np.zeros((steps + 1, 2, n, h), np.float32)
        cell, gates, squashed = np.zeros_like(hidden), np.empty_like(into), np.empty((steps, 2, n, h), np.float32)
        for t in range(steps):
            z = np.tanh(into[t] + hidden[t] @ rec, out=gates[t])
            z[..., :3 * h] *= 0.5
            z[..., :3 * h] += 0.5
            cell[t + 1] = z[..., h:2 * h] * cell[t] + z[..., :h] * z[..., 3 * h:]
            np.tanh(cell[t + 1], out=squashed[t])
            hidden[t + 1] = z[..., 2 * h:3 * h] * squashed[t]
        both = np.concatenate([hidden[1:, 0], hidden[:0:-1, 1]], axis=2)
        return both, [hidden, cell, gates, squashed]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self.states(x)[0] @ self.u + self.b

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Transition and start scores with what may not be forbidden."""
        return np.where(ALLOWED, self.a, np.float32(_FORBIDDEN)), self.s

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (T, B) by Viterbi."""
        e = self.emissions(x)
        a, s = self.steps()
        score = e[0] + s
        back = np.empty((len(x), x.shape[1], TAGS), np.int8)
        for t in range(1, len(x)):
            way = score[:, :, None] + a
            back[t] = way.argmax(axis=1)
            score = way.max(axis=1) + e[t]
        tags = np.empty(x.shape, np.int8)
        tags[-1] = score.argmax(axis=1)
        rows = np.arange(x.shape[1])
        for t in range(len(x) - 1, 0, -1):
            tags[t - 1] = back[t, rows, tags[t]]
        return tags

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags ``y`` (T, B) and its gradients."""
        steps, n = x.shape
        both, kept = self.states(x)
        e = (both @ self.u + self.b).astype(np.float64)
        a, s = (p.astype(np.float64) for p in self.steps())
        way, peak = np.exp(a), e.max(axis=2, keepdims=True)
        here = np.exp(e - peak)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty_like(peak)
        for t in range(steps):  # forward and backward sums, scaled to 1 at each step
            alpha[t] = here[t] * (alpha[t - 1] @ way if t else np.exp(s))
            scale[t] = alpha[t].sum(axis=1, keepdims=True)
            alpha[t] /= scale[t]
        ahead = np.empty_like(e)
        for t in range(steps - 1, -1, -1):
            ahead[t] = here[t] * beta[t] / scale[t]
            if t:
                beta[t - 1] = ahead[t] @ way.T
        at, rows = np.arange(steps)[:, None], np.arange(n)
        gold = e[at, rows, y].sum() + s[y[0]].sum() + a[y[:-1], y[1:]].sum()
        total = (np.log(scale) + peak).sum()
        de = alpha * beta
        da = way * sum(alpha[t - 1].T @ ahead[t] for t in range(1, steps))
        np.subtract.at(da, (y[:-1].ravel(), y[1:].ravel()), 1)
        ds = de[0].sum(axis=0) - np.bincount(y[0], minlength=TAGS)
        de[at, rows, y] -= 1
        de = (de / n).astype(np.float32)
        grads = {"a": np.where(ALLOWED, da / n, 0), "s": ds / n, "b": de.sum(axis=(0, 1)),
                 "u": sum(both[t].T @ de[t] for t in range(steps))}  # small products: one thread each
        grads["w"], grads["r"] = self._back(x, de @ self.u.T, kept)
        return float(total - gold) / n, grads

    def _back(self, x: np.ndarray, dboth: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        hidden, cell, gates, squashed = kept
        h = self.r.shape[1]
        dout = np.stack([dboth[..., :h], dboth[::-1, :, h:]], axis=1)
        dz = np.empty_like(gates)
        dh, dc = np.zeros_like(hidden[0]), np.zeros_like(hidden[0])
        turned, dr = self.r.transpose(0, 2, 1), np.zeros_like(self.r)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g = (gates[t][..., k * h:(k + 1) * h] for k in range(4))
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - squashed[t] ** 2)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * cell[t] * f * (1 - f), dh * squashed[t] * o * (1 - o),
                                    dc * i * (1 - g ** 2)], axis=-1)
            dc = dc * f
            dh = dz[t] @ turned
            dr += hidden[t].transpose(0, 2, 1) @ dz[t]
        dw = np.zeros_like(self.w)
        for d, order in enumerate((x.ravel(), x[::-1].ravel())):
            by = np.argsort(order, kind="stable")
            first = np.flatnonzero(np.diff(order[by], prepend=-1))
            dw[d, order[by][first]] = np.add.reduceat(dz[:, d].reshape(-1, 4 * h)[by], first, axis=0)
        return dw, dr


def _allowed() -> np.ndarray:
    """A further character follows a first or further one of its kind only;
    at the start of a window anything may be."""
    out = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = False
        out[1 + 2 * k, 2 + 2 * k] = out[2 + 2 * k, 2 + 2 * k] = True
    return out


ALLOWED = _allowed()


# --------------------------------------------------------------- training

def labelled(docs: DataFrame, spans: int = TRAIN_SPANS, sample: int = TRAIN_DOCS) -> DataFrame:
    """(kind, left, body, right): base spans with the text before and after,
    at most ``spans`` of each kind, those whose hash is lowest, of about
    ``sample`` documents (a hash of id and text decides).  Equal spans count
    once, so copies of a document do not weigh more."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(0).to_pylist():
            for k, a, b in base_spans(text or ""):
                if b - a <= WINDOW:
                    rows.append((k, text[max(0, a - WINDOW):a], text[a:b], text[b:b + WINDOW]))
        kind, left, body, right = zip(*rows) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *(pa.array(c, pa.string()) for c in (left, body, right))],
                                          ["kind", "left", "body", "right"])

    n = docs.count()
    if n > sample:
        docs = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < sample * (1 << 20) // n)
    rows = arrow_map(docs.select(F.col("text").cast("string")), run, "kind int, left string, body string, right string")
    by = Window.partitionBy("kind").orderBy(F.xxhash64("left", "body", "right"), "left", "body", "right")
    return rows.distinct().withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= spans).drop("nth")


def train(docs: DataFrame, spans: int = TRAIN_SPANS, sample: int = TRAIN_DOCS, hidden: int = 16, steps: int = 220,
          batch: int = 48, seed: int = 11) -> Tagger | None:
    """A tagger trained on base spans of ``docs`` (doc_id, text), at most
    ``spans`` of each kind from about ``sample`` documents; None where there
    is none.

    Each example is a window cut from a labelled span in its context, often
    with digits drawn anew, and with another span or a number beside it, so
    that the network learns where one thing ends and the next one begins."""
    rows = [tuple(r) for r in labelled(docs, spans, sample).collect()]
    return fit(sorted(rows), hidden, steps, batch, seed) if rows else None


def fit(rows: list[tuple[int, str, str, str]], hidden: int = 16, steps: int = 220, batch: int = 48, seed: int = 11) -> Tagger:
    rng = np.random.Generator(np.random.PCG64(seed))
    by_kind = [[r for r in rows if r[0] == k] for k in range(len(KINDS))]
    by_kind = [r for r in by_kind if r]
    net = Tagger.fresh(hidden, seed)
    mean = {n: np.zeros_like(getattr(net, n)) for n in Tagger.NAMES}
    square = {n: np.zeros_like(getattr(net, n)) for n in Tagger.NAMES}
    for step in range(1, steps + 1):
        x, y = zip(*[_example(by_kind, rng) for _ in range(batch)])
        _, grads = net.loss(np.stack(x, axis=1), np.stack(y, axis=1))
        norm = np.sqrt(sum(float((g ** 2).sum()) for g in grads.values()))
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for n, g in grads.items():  # Adam
            g = g * min(1.0, 5 / norm)
            mean[n] += 0.1 * (g - mean[n])
            square[n] += 0.01 * (g ** 2 - square[n])
            move = rate * (mean[n] / (1 - 0.9 ** step)) / (np.sqrt(square[n] / (1 - 0.99 ** step)) + 1e-6)
            setattr(net, n, (getattr(net, n) - move).astype(np.float32))
    return net


def _number(rng) -> str:
    """Something with digits that is no personal data."""
    d = lambda n: "".join(map(str, rng.integers(10, size=n).tolist()))
    k = int(rng.integers(9))
    if k == 0:
        return f"{d(4)}-{d(2)}-{d(2)}"
    if k == 1:
        return f"{d(2)}:{d(2)}:{d(2)}"
    if k == 2:
        return f"{d(int(rng.integers(1, 4)))}.{d(int(rng.integers(1, 5)))}"
    if k == 3:
        return f"{d(1)}.{d(2)}.{d(1)}"
    if k == 4:
        return rng.bytes(int(rng.integers(6, 21))).hex()
    if k == 5:
        return d(int(rng.integers(24, 40)))
    return d(int(rng.integers(1, 13)))


def _redrawn(kind: int, body: str, rng) -> str:
    """The same shape with other digits."""
    out = list(body)
    places = [i for i, c in enumerate(out) if c.isdigit()]
    for i, d in zip(places, rng.integers(10, size=len(places)).tolist()):
        out[i] = str(d)
    if kind == 1:
        return ".".join(str(rng.integers(256)) for _ in range(4))
    return "".join(out)


def _example(by_kind: list, rng) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of one window."""
    def pick():
        group = by_kind[int(rng.integers(len(by_kind)))]
        kind, left, body, right = group[int(rng.integers(len(group)))]
        return kind, left, body if rng.random() < 0.3 else _redrawn(kind, body, rng), right

    kind, left, body, right = pick()
    parts = [(None, left), (kind, body), (None, right)]
    draw = rng.random()
    gap = str(rng.choice([" ", " ", ", ", "  ", " - ", "; ", "\n", "/"]))
    if draw < 0.25:  # another span beside it
        other = pick()
        parts = [(None, left), (kind, body), (None, gap), (other[0], other[2]), (None, right)]
    elif draw < 0.4:
        parts = [(None, left), (None, _number(rng) + gap), (kind, body), (None, right)]
    elif draw < 0.55:
        parts = [(None, left), (kind, body), (None, gap + _number(rng)), (None, right)]
    elif draw < 0.7:  # none at all
        parts = [(None, left), (None, _number(rng)), (None, right)]
    text, tags, spot = "", [], 0
    for k, part in parts:
        if k is not None:
            spot = len(text)
            tags += [1 + 2 * k] + [2 + 2 * k] * (len(part) - 1)
        else:
            # what base patterns find in the context is not known to be right there: it is kept as it is labelled
            inner = [0] * len(part)
            for j, a, b in base_spans(part):
                inner[a:b] = [1 + 2 * j] + [2 + 2 * j] * (b - a - 1)
            tags += inner
        text += part
    spot = spot or len(left)
    start = max(0, min(spot - int(rng.integers(0, WINDOW - 8)) + int(rng.integers(0, 8)), max(0, len(text) - 1)))
    points = np.array([ord(c) for c in text[start:start + WINDOW]], np.int64)
    x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
    x[:len(points)] = classes_of(points)
    y[:len(points)] = tags[start:start + len(points)]
    return x, y


# ---------------------------------------------------------------- finding

def intervals(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that the network reads, of all texts
    of a batch (text i is ``points[off[i]:off[i + 1]]``), apart and in order."""
    lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    digit = np.flatnonzero(points - np.uint32(48) < 10)
    if len(digit):
        text = np.searchsorted(off, digit, "right")
        first = np.flatnonzero(np.concatenate([[True], (np.diff(digit) > 4) | (np.diff(text) > 0)]))
        many = np.diff(np.append(first, len(digit)))
        last = first + many - 1
        lows.append(digit[first[many >= 4]])
        highs.append(digit[last[many >= 4]] + 1)
    at = np.flatnonzero(points == 64)
    for row in np.unique(np.searchsorted(off, at, "right") - 1).tolist():
        a, b = off[row], off[row + 1]
        inside = at[np.searchsorted(at, a):np.searchsorted(at, b)]
        blank = np.concatenate([[a - 1], a + np.flatnonzero(points[a:b] <= 32), [b]])
        spot = np.searchsorted(blank, inside)
        lows.append(blank[spot - 1] + 1)
        highs.append(blank[spot])
    low, high = np.concatenate(lows), np.concatenate(highs)
    if not len(low):
        return low, high
    text = np.searchsorted(off, low, "right") - 1
    low, high = np.maximum(low - CONTEXT, off[text]), np.minimum(high + CONTEXT, off[text + 1])
    order = np.lexsort((high, low))
    low, high, text = low[order], high[order], text[order]
    reach = np.maximum.accumulate(high)
    first = np.flatnonzero(np.concatenate([[True], (low[1:] > reach[:-1]) | (text[1:] != text[:-1])]))
    return low[first], reach[np.append(first[1:], len(low)) - 1]


def tags_of(net: Tagger, points: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 2048) -> np.ndarray:
    """The tags of the stretches, one after the other: each character's is
    that of the window where it lies innermost."""
    size = high - low
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) + np.repeat(low - begin, size)
    kinds = np.append(classes_of(points[place]), 0)
    many = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start, stop = np.repeat(begin, many) + nth * STRIDE, np.repeat(begin + size, many)
    last = nth == np.repeat(many, many) - 1
    edge = (WINDOW - STRIDE) // 2
    own_from = np.where(nth == 0, start, start + edge)
    own_to = np.where(last, stop, start + STRIDE + edge)
    out = np.zeros(len(place), np.int8)
    for a in range(0, len(start), most):
        part = slice(a, a + most)
        spot = start[part] + np.arange(WINDOW)[:, None]
        tags = net.decode(np.where(spot < stop[part], kinds[np.minimum(spot, len(place))], 0))
        owned = (spot >= own_from[part]) & (spot < own_to[part])
        out[spot[owned]] = tags[owned]
    return out


def _trimmed(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    first = "+(0123456789" if kind == 3 else "0123456789"
    while a < b and not (text[a].isalnum() if kind == 0 else text[a] in first):
        a += 1
    while a < b and not (text[b - 1].isalnum() if kind == 0 else "0" <= text[b - 1] <= "9"):
        b -= 1
    return a, b


_SHAPES = [re.compile(r"[^\s@]+@[^\s@]+\.[^\s@.]+"), re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
           re.compile(r"[0-9](?:[ .-]{0,3}[0-9])+"), re.compile(r"(?:\+[ (]{0,2}[0-9]|\([0-9])(?:[ ().-]{0,3}[0-9])+")]


def added_spans(net: Tagger, points: np.ndarray, off: np.ndarray, texts: list[str], base: list[list]) -> list[list]:
    """Per text the spans that the network finds beside the base ones."""
    out = [[] for _ in texts]
    low, high = intervals(points, off)
    if not len(low):
        return out
    tags = tags_of(net, points, low, high)
    begin = np.cumsum(high - low) - (high - low)
    kind = (tags + 1) // 2
    fresh = np.zeros(len(tags), bool)
    fresh[begin] = True
    turn = np.flatnonzero((tags % 2 == 1) | (kind != np.concatenate([[0], kind[:-1]])) | fresh)
    stops = np.append(turn[1:], len(tags))
    real = kind[turn] > 0
    held = {}
    kinds, starts, lengths = kind[turn[real]], turn[real], (stops - turn)[real]
    starts = starts + (low - begin)[np.searchsorted(begin, starts, "right") - 1]
    for k, a, n in zip(kinds.tolist(), starts.tolist(), lengths.tolist()):
        row = int(np.searchsorted(off, a, "right")) - 1
        k, text, shift = k - 1, texts[row], int(off[row])
        b = a + n
        a, b = _trimmed(k, text, a - shift, b - shift)
        if a >= b or not _SHAPES[k].fullmatch(text, a, b) or not accepts(k, text[a:b]):
            continue
        if k and (a and "0" <= text[a - 1] <= "9" or b < len(text) and "0" <= text[b] <= "9"):
            continue
        if row not in held:  # covered stretches, apart and in order
            held[row] = _union(base[row])
        lows, highs = held[row]
        spot = bisect_left(highs, a + 1)
        if spot < len(lows) and lows[spot] < b:
            continue
        out[row].append((k, a, b))
    return out


def _union(spans: list) -> tuple[list, list]:
    lows, highs = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if highs and a < highs[-1]:
            highs[-1] = max(highs[-1], b)
        else:
            lows.append(a)
            highs.append(b)
    return lows, highs


def _found(net: Tagger | None, col: pa.Array) -> tuple[list[str], list[list], list[list]]:
    """(texts, base spans, all spans) of a batch."""
    texts = [t or "" for t in col.to_pylist()]
    base = [base_spans(t) for t in texts]
    if net is None:
        return texts, base, base
    points, off = code_points(col)
    more = added_spans(net, points, off, texts, base)
    return texts, base, [sorted(b + m) if m else b for b, m in zip(base, more)]


def find(docs: DataFrame, net: Tagger | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base, spans) per row
    of ``docs`` (doc_id, text): counts of base spans and of added ones; base
    spans and all spans as kind:start:end (code points, end exclusive), by
    kind in the order of ``KINDS``, then start, joined by commas.

    Null and empty texts have none; repeated rows each give a row; null ids
    stay; other columns are left out; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, base, spans = _found(shared.value, batch.column(1))
        counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in range(len(KINDS))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array([len(s) - len(b) for s, b in zip(spans, base)], pa.int64()),
             pa.array([as_text(b) for b in base], pa.string()), pa.array([as_text(s) for s in spans], pa.string())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "n_added", "base", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run,
                     "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, "
                     "base string, spans string")


def redact(docs: DataFrame, net: Tagger | None) -> DataFrame:
    """Rows of ``docs`` (all columns) with each span of ``text`` replaced by
    its kind in capitals and angle brackets, the earliest of overlapping ones;
    null texts stay null."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, _, spans = _found(shared.value, batch.column(at))
        out = []
        for text, found, there in zip(texts, spans, batch.column(at).is_valid().to_pylist()):
            parts, done = [], 0
            for a, b, k in sorted((a, b, k) for k, a, b in found):
                if a >= done:
                    parts += [text[done:a], f"<{KINDS[k].upper()}>"]
                    done = b
            out.append("".join(parts) + text[done:] if there else None)
        return batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return arrow_map(docs, run, docs.schema)
