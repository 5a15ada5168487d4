"""Hashed text features, vectorised over the bytes of a whole batch.

Texts are laid out one after the other, a blank before, between and after
them, ASCII controls and blanks as 0x20.  A word is a run of other bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from logloom.llm.common import raw_bytes

BLANKS = bytes(32 if c <= 32 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Laid:
    """A batch of texts as one buffer; text i is ``data[starts[i]:ends[i]]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @cached_property
    def fours(self) -> np.ndarray:
        """The four bytes from each position on, as one number."""
        n = len(self.data) - 3
        return np.ndarray((n,), "<u4", self.data, strides=(1,)).copy()

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word."""
        solid = self.data != 32
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        return edge[0::2], edge[1::2]

    @cached_property
    def word_range(self) -> np.ndarray:
        """Text i has the words ``word_range[i]:word_range[i + 1]``."""
        return np.append(np.searchsorted(self.words[0], self.starts), len(self.words[0]))

    @cached_property
    def word_hashes(self) -> np.ndarray:
        """64 bits per word: the sum of a hash of the three bytes around each
        of its bytes (its neighbours outside are blanks)."""
        total = np.zeros(len(self.data), np.uint64)
        np.cumsum(mix((self.fours[:-1] & np.uint32(0xFFFFFF)).astype(np.uint64)), out=total[2:-2])
        a, b = self.words
        return mix(total[b] - total[a])


def lay_out(col: pa.Array, table: bytes = BLANKS) -> Laid:
    """``table``: what each byte is read as; a null text is empty."""
    data, off = raw_bytes(col)
    whole = data.tobytes()
    buf = b" " + b" ".join([whole[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]) + b"      "
    shift = np.arange(len(off) - 1) + 1
    return Laid(np.frombuffer(buf.translate(table), np.uint8), off[:-1] + shift,
                off[1:] + shift)


def indicators(col: pa.Array, bits: int = 18) -> list[np.ndarray]:
    """Per text the distinct indices (in no order) below 2**bits of its byte
    three-grams, words, word pairs, and runs of up to six "same word as the
    one before / another word" marks."""
    laid = lay_out(col)
    grams = ((laid.fours & np.uint32(0xFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    down = np.uint64(64 - bits)
    words = laid.word_hashes
    single = words >> down
    pair = mix(words[:-1] * np.uint64(3) + words[1:]) >> down if len(words) else words
    same = np.zeros(len(words), np.uint64)
    same[1:] = words[1:] == words[:-1]
    stamp = np.zeros(1 << bits, np.int32)
    at = laid.word_range.tolist()
    out = []
    for i, (a, b) in enumerate(zip(laid.starts.tolist(), laid.ends.tolist())):
        u, v = at[i], at[i + 1]
        parts = [grams[a - 1:b - 1] if b > a else grams[:0], single[u:v], pair[u:max(u, v - 1)]]
        marks = same[u + 1:v]
        if marks.any():
            parts.append(_patterns(marks) >> down)
        found = np.concatenate(parts).astype(np.int32)
        # of equal values the one written last stays
        place = np.arange(len(found), dtype=np.int32)
        stamp[found] = place
        out.append(found[stamp[found] == place])
    return out


def _patterns(marks: np.ndarray) -> np.ndarray:
    """Hashes of all runs of two to six of the 0/1 marks."""
    out = []
    for n in range(2, 7):
        code = np.full(max(0, len(marks) - n + 1), n, np.uint64)
        for k in range(n):
            code = code * np.uint64(2) + marks[k:max(k, len(marks) - n + 1 + k)]
        out.append(mix(code + np.uint64(1 << 40)))
    return np.concatenate(out)
