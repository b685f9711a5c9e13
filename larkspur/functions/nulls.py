"""Orders and divisions with PostgreSQL's view of NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered(c: Column, descending: bool = False) -> Column:
    """NULLs are the greatest: last ascending, first descending."""
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def score_ordered(c: Column, descending: bool = True) -> Column:
    """For scores: rows without one are last either way, NaN after all numbers ascending."""
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double, NaN where b is 0."""
    b = b.cast("double")
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a.cast("double") / b)


def number(c: Column) -> Column:
    """A score's field: 0 where it is missing."""
    return F.coalesce(c.cast("double"), F.lit(0.0))
