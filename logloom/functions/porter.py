"""Porter (1980) stemmer, byte-wise, as used by the full-text index.

Works on the UTF-8 bytes of an already folded token; only ASCII ``aeiou``
(and ``y`` in context) are vowels, every other byte is a consonant.  Tokens
shorter than 3 or longer than 64 bytes are returned unchanged.  This is a
small per-token helper; it runs inside a vectorised UDF on distinct tokens.
"""

from __future__ import annotations

MIN_LEN, MAX_LEN = 3, 64

# The suffix rules of the algorithm, step by step, in the order
# they are tried; the first suffix that matches (leaving a non-empty stem)
# decides, and its condition alone says whether it is replaced.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [
    ("ical", "ic"), ("ness", ""), ("icate", "ic"), ("iciti", "ic"), ("ful", ""), ("ative", ""), ("alize", "al"),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]

_VOWELS = frozenset(b"aeiou")
_Y = ord("y")


def _is_vowel(c: int, y_is_vowel: bool) -> bool:
    return c in _VOWELS or (y_is_vowel and c == _Y)


def _cons_flags(w: bytes, prev_cons: bool = False) -> list[bool]:
    flags, cons = [], prev_cons
    for c in w:
        cons = not _is_vowel(c, cons)
        flags.append(cons)
    return flags


def _measure(w: bytes) -> int:
    """Number of vowel-consonant sequences in ``w``."""
    m, seen_vowel = 0, False
    for cons in _cons_flags(w):
        if not cons:
            seen_vowel = True
        elif seen_vowel:
            m += 1
            seen_vowel = False
    return m


def _has_vowel(w: bytes) -> bool:
    # ``y`` counts as a vowel anywhere but at the start
    return any(_is_vowel(c, i > 0) for i, c in enumerate(w))


def _ends_cvc(w: bytes) -> bool:
    if not w or w[-1] in b"wxy":
        return False
    f = _cons_flags(w)
    return len(f) >= 3 and f[-3] and not f[-2] and f[-1]


def _rule_step(w: bytes, rules, min_m: int) -> bytes:
    for suffix, repl in rules:
        if len(w) > len(suffix) and w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + repl if _measure(stem) > min_m else w
    return w


_STEP2 = [(a.encode(), b.encode()) for a, b in STEP2]
_STEP3 = [(a.encode(), b.encode()) for a, b in STEP3]
_STEP4 = [s.encode() for s in STEP4]


def _step1a(w: bytes) -> bytes:
    if w.endswith(b"s"):
        if w[-2:-1] == b"e":
            if (len(w) > 4 and w.endswith(b"sses")) or (len(w) > 3 and w[-3:-2] == b"i"):
                return w[:-2]
            return w[:-1]
        if w[-2:-1] != b"s":
            return w[:-1]
    return w


def _step1b(w: bytes) -> bytes:
    removed = None
    if len(w) > 3 and w.endswith(b"eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    if len(w) > 2 and w.endswith(b"ed") and _has_vowel(w[:-2]):
        removed = w[:-2]
    elif len(w) > 3 and w.endswith(b"ing") and _has_vowel(w[:-3]):
        removed = w[:-3]
    if removed is None:
        return w
    w = removed
    if len(w) > 2 and w[-2:] in (b"at", b"bl", b"iz"):
        return w + b"e"
    last = w[-1]
    if (len(w) >= 2 and not _is_vowel(last, False) and last not in b"lsz" and last == w[-2]):
        return w[:-1]
    if _measure(w) == 1 and _ends_cvc(w):
        return w + b"e"
    return w


def _step4(w: bytes) -> bytes:
    for suffix in _STEP4:
        if len(w) > len(suffix) and w.endswith(suffix):
            stem = w[: -len(suffix)]
            if suffix == b"ion" and not stem.endswith((b"s", b"t")):
                return w
            return stem if _measure(stem) > 1 else w
    return w


def stem_bytes(w: bytes) -> bytes:
    if len(w) < MIN_LEN or len(w) > MAX_LEN:
        return w
    w = _step1a(w)
    w = _step1b(w)
    if w.endswith(b"y") and _has_vowel(w[:-1]):
        w = w[:-1] + b"i"
    w = _rule_step(w, _STEP2, 0)
    w = _rule_step(w, _STEP3, 0)
    w = _step4(w)
    if w.endswith(b"e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if len(w) > 1 and w.endswith(b"ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stem(token: str) -> str:
    """Stem one folded token."""
    return stem_bytes(token.encode("utf-8")).decode("utf-8", errors="replace")
