"""``let``: evaluate an expression once and use it many times.

Expressions referenced inside a lambda are evaluated again for every array
element, and common-subexpression elimination does not reach into lambdas.
Binding the value to a lambda variable of a one-element ``transform`` makes
every later use a cheap variable read.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def pinned(c: Column) -> Column:
    """Identity Catalyst treats as non-deterministic (a partition id is never
    negative): a filter or column built on it is not pushed below the
    projection or repartition it sits on.  Used where pushing work down
    would move it before the step that spreads it over the cores, or would
    copy a large shared expression into a filter."""
    return F.when(F.spark_partition_id() >= 0, c)
