"""Small column expressions with the engine's null rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def held(predicate: Column) -> Column:
    """A predicate that is false, never null, where something is missing."""
    return F.coalesce(predicate, F.lit(False))


def code(column: Column, kind: str) -> Column:
    """A category code as text: 1 and 1.0 are the same code, 1.5 is another; NaN is missing."""
    if kind in ("double", "float"):
        whole = F.when(column == F.floor(column), F.floor(column).cast("bigint").cast("string")).otherwise(column.cast("string"))
        return F.when(column.isNotNull() & ~F.isnan(column), whole)
    return column.cast("string")


def finite(column: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    bad = F.isnan(column) | column.isin(float("inf"), float("-inf"))
    return F.when(~bad, column)


def flag(predicate: Column) -> Column:
    """1.0 or 0.0, null where the predicate is unknown."""
    return F.when(predicate, 1.0).when(~predicate, 0.0)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where the bottom is 0 or missing."""
    return F.when(bottom != 0, top / bottom)


def printed(column: Column, digits: int = 6) -> Column:
    """A number rounded so that exact ties fall the same way in other engines."""
    return F.round(column + 1e-9, digits)


def every(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)


def some(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)
