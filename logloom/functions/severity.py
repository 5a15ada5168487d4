"""Severity: text -> number, number -> label, and detection by pattern."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference for identical results.
# Accepted spellings (whole-upper or whole-lower only) and their levels.
SEVERITY_WORDS = {
    "TRACE": 1, "trace": 1,
    "DEBUG": 2, "debug": 2,
    "INFO": 3, "info": 3,
    "WARN": 4, "warn": 4, "WARNING": 4, "warning": 4,
    "ERROR": 5, "error": 5,
    "FATAL": 6, "fatal": 6, "PANIC": 6, "panic": 6,
}
# Labels by level 0..6, long and three-letter forms.
SEVERITY_LABELS = ["UNKNOWN", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
SEVERITY_SHORT = ["UNK", "TRC", "DBG", "INF", "WRN", "ERR", "FTL"]
# The level words the line patterns look for, and the four
# patterns in the order they are tried (first hit wins).  ``\b`` is written
# as ASCII look-arounds so that it behaves the same on any JVM.
_LEVEL_ALT = "TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|PANIC"
_ANY_WORD = "trace|debug|info|warn|error|fatal|panic"
_WB_BEFORE = "(?<![A-Za-z0-9_])"
_WB_AFTER = "(?![A-Za-z0-9_])"
SEVERITY_PATTERNS = [
    r'(?i)"level"[\t\n\f\r ]*:[\t\n\f\r ]*"(' + _LEVEL_ALT + r')"',
    r"(?i)\[(" + _LEVEL_ALT + r")\]",
    r"(?i)level=(" + _LEVEL_ALT + ")" + _WB_AFTER,
    r"(?i)" + _WB_BEFORE + "(" + _LEVEL_ALT + "):",
]


def _word_map() -> Column:
    return F.create_map(*[x for k, v in SEVERITY_WORDS.items() for x in (F.lit(k), F.lit(v))])


def severity_of(text: Column | str) -> Column:
    """Severity text -> level 0..6 (unknown spelling -> 0). NULL -> 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.try_element_at(_word_map(), text), F.lit(0)).cast("int")


def severity_label(level: Column | str, short: bool = False) -> Column:
    """Level -> label; out of range -> UNKNOWN / UNK."""
    level = F.col(level) if isinstance(level, str) else level
    labels = SEVERITY_SHORT if short else SEVERITY_LABELS
    arr = F.array(*[F.lit(x) for x in labels])
    return F.when((level >= 1) & (level <= 6), F.try_element_at(arr, (level + 1).cast("int"))) \
        .otherwise(F.lit(labels[0]))


def severity_from_pattern(message: Column | str) -> Column:
    """First of the four line patterns that matches, upper-cased -> level; else 0."""
    message = F.col(message) if isinstance(message, str) else message
    hits = [F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in SEVERITY_PATTERNS]
    # every pattern needs one of the level words: one cheap test first
    return F.when(F.lower(message).rlike(_ANY_WORD), severity_of(F.upper(F.coalesce(*hits)))).otherwise(F.lit(0))


def severity_from_fields(fields: Column, string_only: Column | None = None) -> Column:
    """Level from the ``level``, ``severity``, ``lvl`` entries of a map, in that
    order; the first that names a known level wins; 0 when none does.

    ``fields`` is a MAP<STRING,STRING>.  For JSON only string values count; the
    caller passes such a pre-filtered map.
    """
    tries = [F.nullif(severity_of(F.try_element_at(fields, F.lit(k))), F.lit(0))
             for k in ("level", "severity", "lvl")]
    return F.coalesce(*tries, F.lit(0)).cast("int")
