"""Small text helpers: ANSI colour stripping and value truncation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ESC [ digits;... m  (SGR colour sequences)
ANSI_SGR = "\u001b\\[[0-9;]*m"


def strip_ansi(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, ANSI_SGR, "")


def truncate_value(text: Column | str, width: int = 12) -> Column:
    """Longer than ``width`` -> first ``width - 1`` characters and an ellipsis."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))).otherwise(text)
