"""logfmt lines -> key/value fields, with one anchored regular expression.

Each ``\\G``-anchored match is one token: a ``key=value`` pair (quoted or bare
value) or a bad token that is skipped up to the next blank.  Three calls of
``regexp_extract_all`` return the aligned groups key, quoted text, bare text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logloom.functions.attrs import last_wins

# Key characters [A-Za-z0-9_.-]; only space and tab separate tokens; a quoted
# value may end without its closing quote; a closing quote may be followed
# directly by the next key.
LOGFMT_TOKEN = (r'(?s)\G[ \t]*+(?:([A-Za-z0-9_.-]++)=(?:"((?:\\.|[^"\\])*+\\?)"?|([^ \t]*+))|[^ \t]++)')
# Pieces of a quoted value: an escape pair, a run without backslash, or a
# trailing lone backslash.
_ESCAPE_PIECES = r"(?s)\\.|[^\\]+|\\"
_BIG = 1 << 30


def unescape(quoted: Column) -> Column:
    r"""``\" \\ \n \t \r`` decode; any other ``\x`` gives ``x``; a trailing
    lone backslash stays."""
    pieces = F.regexp_extract_all(quoted, F.lit(_ESCAPE_PIECES), F.lit(0))

    def dec(p: Column) -> Column:
        return (F.when(p == F.lit("\\n"), F.lit("\n"))
                .when(p == F.lit("\\t"), F.lit("\t"))
                .when(p == F.lit("\\r"), F.lit("\r"))
                .when((F.length(p) == 2) & p.startswith("\\"), F.substring(p, 2, 1))
                .otherwise(p))

    return F.when(F.contains(quoted, F.lit("\\")), F.array_join(F.transform(pieces, dec), "")).otherwise(quoted)


def logfmt_pairs(message: Column) -> Column:
    """Message -> array<struct<key, value>> of all pairs in order (duplicates
    kept); empty values are kept (they still count as fields)."""
    groups = [F.regexp_extract_all(message, F.lit(LOGFMT_TOKEN), F.lit(g)) for g in (1, 2, 3)]
    zipped = F.arrays_zip(groups[0].alias("k"), groups[1].alias("q"), groups[2].alias("u"))
    pairs = F.transform(F.filter(zipped, lambda x: x["k"] != ""),
                        lambda x: F.struct(x["k"].alias("key"),
                                           F.when(x["q"] != "", unescape(x["q"])).otherwise(x["u"]).alias("value")))
    return pairs


def logfmt_fields(message: Column) -> Column:
    """Pairs with the last duplicate key winning."""
    return last_wins(logfmt_pairs(message))


def is_logfmt_candidate(message: Column) -> Column:
    """logfmt is only tried on messages with ``=`` that do not start with ``{``."""
    return F.contains(message, F.lit("=")) & ~message.startswith("{")
