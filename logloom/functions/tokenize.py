"""Full-text tokens: fold case and single-mark Latin diacritics, split into
runs of letters, digits and private-use characters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

TOKEN_SPLIT = r"[^\p{L}\p{N}\p{Co}]+"
# Latin blocks whose letters may carry a removable diacritic.
_LATIN_RANGES = ((0x00C0, 0x024F), (0x1E00, 0x1EFF))


@lru_cache(maxsize=1)
def diacritic_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: every Latin letter whose canonical
    decomposition is one ASCII letter plus exactly one combining mark maps
    to that letter.  Letters with two marks (``ệ``) and letters without a
    decomposition (``ø``, ``ß``) stay as they are."""
    src, dst = [], []
    for lo, hi in _LATIN_RANGES:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            nfd = unicodedata.normalize("NFD", ch)
            if (len(nfd) == 2 and nfd[0].isascii() and nfd[0].isalpha()
                    and unicodedata.combining(nfd[1])):
                src.append(ch)
                dst.append(nfd[0])
    return "".join(src), "".join(dst)


#: Combining marks that the full-text tokenizer takes as part of a word and
#: leaves out (fixed values: SQLite's bit masks over U+0300..U+0331).
_MARKS = "".join(chr(0x300 + i) for i in range(50)
                 if (0x08029FDF >> i & 1 if i < 32 else 0x000361F8 >> (i - 32) & 1))


def fold(text: Column) -> Column:
    src, dst = diacritic_table()
    return F.lower(F.translate(text, src + _MARKS, dst))


def tokenize(text: Column | str) -> Column:
    """Text -> array of folded tokens in order (no stemming)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(fold(text), TOKEN_SPLIT), lambda t: t != "")


def fold_py(text: str) -> str:
    """Driver-side fold of a query word, same rule as :func:`fold`."""
    src, dst = diacritic_table()
    return text.translate(str.maketrans(src, dst, _MARKS)).lower()


def tokenize_py(text: str) -> list[str]:
    """Driver-side tokenizer for query words (not for data)."""
    out, word = [], ""
    for ch in fold_py(text) + " ":
        if unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co":
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out
