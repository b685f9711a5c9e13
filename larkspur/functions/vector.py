"""Vector distances as higher-order expressions. Vectors are arrays of float or double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(q: list[float]) -> Column:
    """In single precision, as vectors are kept."""
    return F.array(*[F.lit(float(x)).cast("float").cast("double") for x in q])


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _zip(v: Column, q: Column, f) -> Column:
    return _sum(F.zip_with(v.cast("array<double>"), q, f))


def dot(v: Column, q: Column) -> Column:
    return _zip(v, q, lambda a, b: a * b)


def l2(v: Column, q: Column) -> Column:
    """The square of the Euclidean distance."""
    return _zip(v, q, lambda a, b: (a - b) * (a - b))


def l1(v: Column, q: Column) -> Column:
    return _zip(v, q, lambda a, b: F.abs(a - b))


def cosine_distance(v: Column, q: Column) -> Column:
    """1 - similarity, and 1 for a zero vector."""
    norm = F.sqrt(_sum(F.transform(v.cast("array<double>"), lambda a: a * a))) * F.sqrt(_sum(F.transform(q, lambda a: a * a)))
    return F.when(v.isNull(), None).when(norm == 0, 1.0).otherwise(1 - dot(v, q) / norm)


#: operator -> distance, smaller is nearer
OPERATORS = {"<=>": cosine_distance, "<->": l2, "<#>": lambda v, q: -dot(v, q), "<+>": l1}
#: function -> score term
FUNCTIONS = {"VECTOR_COSINE": lambda v, q: 1 - cosine_distance(v, q), "VECTOR_L2": l2, "VECTOR_DOT": dot, "VECTOR_L1": l1}
METRICS = {"cosine": cosine_distance, "l2": l2, "dot": lambda v, q: -dot(v, q), "l1": l1}
