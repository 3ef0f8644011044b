"""Array helpers for higher-order functions.

Spark evaluates a lambda body once per element and does not hoist
sub-expressions that do not depend on the element.  An array computed
outside a ``transform`` and used inside it would be recomputed for every
element (quadratic or worse).  ``let`` binds such a value once per row:
it is the argument of a one-element ``transform``, so inside ``fn`` it is
a lambda variable, evaluated before the body runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(v)`` with ``v`` = ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), fn), 0)


def index_range(n: Column, start: int = 0) -> Column:
    """``[start, ..., n-1]`` (empty when n <= start; ``sequence`` alone
    would count down)."""
    return F.when(n > start, F.sequence(F.lit(start), n - 1)).otherwise(F.array().cast("array<int>"))
