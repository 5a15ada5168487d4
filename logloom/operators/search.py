"""Full-text predicates over the ``terms`` column (stemmed tokens in order).

Predicates compose with ``&`` (AND), ``|`` (OR) and ``-``/``&~`` (binary
NOT: left without right).  Query words go through the same fold, tokenizer
and stemmer as the data, once, on the driver; a word that yields several
tokens is a phrase.  Result order is never by relevance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from logloom.functions.stem import query_terms

TERMS = "terms"


# The stemmer only rewrites a word's ending, and at most the last two
# characters of a stem differ from the word it came from (step 2 can turn
# "-biliti" into "-ble"; later steps only cut).  So a message can only hold
# a token with stem ``s`` if its folded text contains ``s[:-2]``: a cheap,
# exact-safe JVM pre-filter before any stemming.
STEM_DRIFT = 2


def _root(stem: str) -> str:
    return stem[: max(0, len(stem) - STEM_DRIFT)]


def _all(cols):
    cols = [c for c in cols if c is not None]
    if not cols:
        return None
    out = cols[0]
    for c in cols[1:]:
        out = out & c
    return out


class Match:
    """A search predicate; ``column(terms)`` gives the boolean Column."""

    def column(self, terms: Column) -> Column:  # pragma: no cover - abstract
        raise NotImplementedError

    def candidates(self, folded: Column) -> Column | None:
        """A superset test on the folded message text (None: no restriction)."""
        return None

    def __and__(self, other: "Match") -> "Match":
        return _And(self, other)

    def __or__(self, other: "Match") -> "Match":
        return _Or(self, other)

    def __sub__(self, other: "Match") -> "Match":
        return _Not(self, other)

    def __invert__(self) -> "_Negated":
        return _Negated(self)


@dataclass(frozen=True)
class _And(Match):
    a: Match
    b: Match

    def column(self, terms):
        b = self.b
        if isinstance(b, _Negated):
            return self.a.column(terms) & ~b.inner.column(terms)
        return self.a.column(terms) & b.column(terms)

    def candidates(self, folded):
        if isinstance(self.b, _Negated):
            return self.a.candidates(folded)
        return _all([self.a.candidates(folded), self.b.candidates(folded)])


@dataclass(frozen=True)
class _Or(Match):
    a: Match
    b: Match

    def column(self, terms):
        return self.a.column(terms) | self.b.column(terms)

    def candidates(self, folded):
        ca, cb = self.a.candidates(folded), self.b.candidates(folded)
        return None if ca is None or cb is None else ca | cb


@dataclass(frozen=True)
class _Not(Match):
    a: Match
    b: Match

    def column(self, terms):
        return self.a.column(terms) & ~self.b.column(terms)

    def candidates(self, folded):
        return self.a.candidates(folded)


@dataclass(frozen=True)
class _Negated(Match):
    """Only valid on the right of ``&`` (binary NOT, as in the query syntax)."""
    inner: Match

    def column(self, terms):
        raise ValueError("NOT needs a left operand: use a & ~b or a - b")


def _joined(terms: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))


@dataclass(frozen=True)
class Phrase(Match):
    """Consecutive stems; with ``prefix`` the last one matches as a prefix."""
    stems: tuple[str, ...]
    prefix: bool = False

    def column(self, terms):
        if not self.stems:  # no token in the text: it occurs nowhere
            return F.lit(False)
        if len(self.stems) == 1:
            s = self.stems[0]
            if self.prefix:
                return F.exists(terms, lambda t: t.startswith(s))
            return F.array_contains(terms, F.lit(s))
        if not self.prefix:
            return F.contains(_joined(terms), F.lit(" " + " ".join(self.stems) + " "))
        head = " " + " ".join(self.stems[:-1]) + " " + self.stems[-1]
        return F.contains(_joined(terms), F.lit(head))

    def candidates(self, folded):
        return _all([F.contains(folded, F.lit(_root(s))) if _root(s) else None for s in self.stems])


@dataclass(frozen=True)
class Initial(Match):
    """The first token of the message is the stem."""
    stem: str

    def column(self, terms):
        return F.coalesce(F.try_element_at(terms, F.lit(1)) == F.lit(self.stem), F.lit(False))

    def candidates(self, folded):
        return F.contains(folded, F.lit(_root(self.stem))) if _root(self.stem) else None


@dataclass(frozen=True)
class Near(Match):
    """Phrases with at most ``n`` tokens between the end of the first and the
    start of the last of them, in any order."""
    phrases: tuple[tuple[str, ...], ...]
    n: int = 10

    def column(self, terms):
        if not all(self.phrases):
            return F.lit(False)
        def marked(k):
            return F.transform(_starts(terms, self.phrases[k]), lambda at: F.struct(at.alias("at"), F.lit(k).alias("which")))

        events = F.array_sort(F.concat(*[marked(k) for k in range(len(self.phrases))]))
        size = F.array(*[F.lit(len(p)) for p in self.phrases])
        none = F.array(*[F.lit(-1) for _ in self.phrases])

        def step(state, e):
            # the last start of every phrase up to here: the tightest cluster that ends here
            last = F.transform(state["last"], lambda v, k: F.when(k == e["which"], e["at"]).otherwise(v))
            ends = F.zip_with(last, size, lambda v, n: F.struct(v.alias("at"), (v + n).alias("end")))
            between = e["at"] - F.array_min(ends)["end"]
            return F.struct(last.alias("last"), (state["hit"] | ((F.array_min(last) >= 0) & (between <= self.n))).alias("hit"))

        return F.aggregate(events, F.struct(none.alias("last"), F.lit(False).alias("hit")), step, lambda s: s["hit"])

    def candidates(self, folded):
        return _all([F.contains(folded, F.lit(_root(s))) if _root(s) else None for p in self.phrases for s in p])


def _starts(terms: Column, stems: tuple[str, ...]) -> Column:
    """Positions (from 0) at which the phrase starts."""
    at = F.when(F.size(terms) > 0, F.sequence(F.lit(0), F.size(terms) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.coalesce(_all(
        [F.try_element_at(terms, i + (k + 1)) == F.lit(s) for k, s in enumerate(stems)]), F.lit(False)))


def term(word: str) -> Match:
    """One word; several tokens in it make a phrase."""
    return Phrase(tuple(query_terms(word)))


def phrase(text: str) -> Match:
    return Phrase(tuple(query_terms(text)))


def prefix(word: str) -> Match:
    """``word*``: the word is stemmed, then matched as a prefix of a stem."""
    return Phrase(tuple(query_terms(word)), prefix=True)


def initial(word: str) -> Match:
    stems = query_terms(word)
    if len(stems) != 1:
        raise ValueError("initial() takes one token")
    return Initial(stems[0])


def near(*texts: str, n: int = 10) -> Match:
    """Words or phrases close to each other, in any order."""
    return Near(tuple(tuple(query_terms(t)) for t in texts), n)


def all_words(text: str) -> Match | None:
    """Plain search text: every blank-separated word must occur (a word of
    several tokens is a phrase, one without a token occurs nowhere).  Empty
    text is no filter (None)."""
    words = [term(w) for w in text.split()]
    if not words:
        return None
    out = words[0]
    for p in words[1:]:
        out = out & p
    return out


def with_terms(df, pre_filter: Column | None = None):
    """Add the ``terms`` column where the frame has none (a stored log table
    has it); ``pre_filter`` drops rows before they are stemmed."""
    if TERMS in df.columns:
        return df
    from logloom.functions.stem import terms

    base = df if pre_filter is None else df.where(pre_filter)
    return base.withColumn(TERMS, terms(F.col("message")))


def search(df, match: Match | str | None, terms_col: str = TERMS):
    """Keep rows whose message matches.  Apply other filters before this one:
    the stems are then computed only for the rows that survive them."""
    if isinstance(match, str):
        match = all_words(match)
    if match is None:
        return df
    if terms_col == TERMS and TERMS not in df.columns:
        from logloom.functions.tokenize import fold

        df = with_terms(df, pre_filter=match.candidates(fold(F.col("message"))))
    return df.where(match.column(F.col(terms_col)))
