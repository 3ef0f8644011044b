"""Registered queries: each pairs a Spark plan with its DuckDB oracle SQL.

A query is an operator (or a short chain of them) applied to the stand-in
views of ``lethe.plans.views`` over the whole driver tables.  Computed
columns carry the same alias on both sides; doubles are rounded to six
places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    """Six decimals (HALF_UP on the exact value; never a negative zero)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Means over powers of two end in an exact half of the last place, which the
# two engines round apart; both add this first.
OFF_TIE = 1e-10


def shown(c: str) -> list[F.Column]:
    """A loss that may be no ordinary number, as two columns: rounded like
    ``r6`` where it is below 1e12, and the word for it elsewhere."""
    x = F.col(c)
    small = ~F.isnan(x) & (F.abs(x) < 1e12)
    word = (F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
            .when(small, "").when(x.isNotNull(), F.format_string("%.4e", x)))
    return [F.when(small, F.round(x + OFF_TIE, 6) + 0.0).alias(c), word.alias(c + "_word")]


def shown_sql(expr: str, name: str) -> str:
    """``shown`` for DuckDB (NaN is above all numbers there)."""
    x = f"({expr})"
    return (f"CASE WHEN abs({x}) < 1e12 THEN round({x} + {OFF_TIE!r}, 6) + 0.0 END AS {name}, "
            f"CASE WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END "
            f"WHEN abs({x}) < 1e12 THEN '' WHEN {x} IS NOT NULL THEN printf('%.4e', {x}) END AS {name}_word")


def domain(spark: SparkSession, **cols) -> DataFrame:
    """Cartesian product of a few fixed labels (e.g. sets x kinds), built
    as literal rows: the groups a report always lists."""
    import itertools
    names = list(cols)
    rows = list(itertools.product(*[cols[n] for n in names]))
    typ = lambda vals: "int" if all(isinstance(v, int) for v in vals) else "string"
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {typ(cols[n])}" for n in names))


# Importing the modules fills QUERIES and ORACLES.
from lethe.plans import (  # noqa: E402,F401,I001
    q_batches, q_curate, q_eval, q_losses, q_prompts, q_roundtrip, q_scoring, q_splits)
