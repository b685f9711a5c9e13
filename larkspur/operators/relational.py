"""Row identity, sets of rows, upserts and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_lowest(df: DataFrame, columns: list[str], key: str = "_key") -> DataFrame:
    """One row for each value of columns: that of the lowest key."""
    rest = [c for c in df.columns if c not in columns]
    least = F.min(F.struct(key, *[c for c in rest if c != key])).alias("_r")
    picked = df.groupBy(*columns).agg(least)
    return picked.select(*[F.col(c) if c in columns else F.col(f"_r.{c}").alias(c) for c in df.columns])


def intersect(a: DataFrame, b: DataFrame, key: str = "_id") -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def subtract(a: DataFrame, b: DataFrame, key: str = "_id") -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def union(a: DataFrame, b: DataFrame, key: str = "_id") -> DataFrame:
    """Rows of a, and those of b that a doesn't have."""
    return a.unionByName(subtract(b, a, key), allowMissingColumns=True)


def upsert(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces the rows of df that have its keys."""
    return df.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_unless(df: DataFrame, condition: Column) -> DataFrame:
    """What a DELETE leaves: rows for which the condition isn't true, the unknown ones too."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; each task keeps k, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(k)


def reciprocal_rank_fusion(rankings: list[tuple[DataFrame, Column, float]], key: str = "_id", k: int = 60) -> DataFrame:
    """(key, score): the weighted sum of 1 / (k + rank) over rankings (rows, order, weight).

    Each ranking is a list that was already cut to its best rows (it has a limit), so one task can number it.
    """
    parts = None
    for df, order, weight in rankings:
        rank = F.row_number().over(Window.orderBy(order, F.col(key)))
        part = df.select(key, (F.lit(float(weight)) / (k + rank)).alias("_part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.sum("_part").alias("score"))
