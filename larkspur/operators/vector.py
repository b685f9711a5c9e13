"""Nearest neighbours: exact top-k, a two-stage top-k over int8 codes, and a join of many queries.

All are exact or nearly so and need no index. Each task keeps its k best and only those move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..errors import QueryError
from ..functions import vector as V
from ..scratch import written

BLOCK_NUMBERS = 1 << 22
#: More than the rounding of distances to 9 digits can move one.
NEAR = 2e-9


def nearest(df: DataFrame, column: str, query: list[float], k: int, metric: str = "cosine", key: str = "_key") -> DataFrame:
    """The k rows nearest to the query, nearest first, equal ones by key; rows without a vector don't count."""
    d = V.METRICS[metric](F.col(column), V.literal(query))
    return df.filter(F.col(column).isNotNull()).withColumn("_distance", d).orderBy("_distance", key).limit(k)


def check_width(df: DataFrame, column: str, query: list[float]) -> None:
    """Raise if the column's vectors have another width; one row is read."""
    row = df.filter(F.col(column).isNotNull()).select(F.size(column)).first()
    if row is not None and row[0] != len(query):
        raise QueryError(f"{column} has vectors of {row[0]} numbers, the query has {len(query)}")


def calibrated(df: DataFrame, column: str) -> tuple[float, float]:
    """The 0.5 and 99.5 percentiles of all coordinates, between which int8 codes are spread."""
    lo, hi = df.select(F.explode(column).alias("x")).agg(F.percentile_approx("x", F.array(F.lit(0.005), F.lit(0.995)), 10_000)).first()[0]
    return float(lo), float(hi)


def quantised(df: DataFrame, column: str, bounds: tuple[float, float], name: str = "_code") -> DataFrame:
    """df with int8 codes of the vectors."""
    lo, hi = bounds
    span = (hi - lo) or 1.0
    return df.withColumn(name, F.transform(column, lambda x: F.least(F.greatest(F.round((x - lo) / span * 254 - 127), F.lit(-127.0)), F.lit(127.0)).cast("tinyint")))


def nearest_compact(df: DataFrame, column: str, query: list[float], k: int, bounds: tuple[float, float], oversample: int = 8, code: str = "_code", key: str = "_key") -> DataFrame:
    """Top k * oversample by int8 codes (L2), then exact among those."""
    lo, hi = bounds
    span = (hi - lo) or 1.0
    q = [max(-127.0, min(127.0, round((float(np.float32(x)) - lo) / span * 254 - 127))) for x in query]
    first = df.filter(F.col(code).isNotNull()).orderBy(V.l2(F.col(code), V.literal(q)), key).limit(k * oversample)
    return nearest(first, column, query, k, "l2", key)


def nearest_join(df: DataFrame, column: str, queries: DataFrame, k: int, metric: str = "cosine", key: str = "_key", block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(query, key, distance): the k rows of df nearest to each row of queries (query, vector), equal ones by key.

    The queries are asked in blocks of about block_numbers coordinates, by matrix products on Arrow batches; each
    task keeps k rows a query over all its batches, and only those move. Distances are rounded to 9 digits, so that
    equal vectors tie whatever batch they are in. Rows and queries without a vector don't count.
    """
    spark = df.sparkSession
    queries = queries.select(F.col("query").cast("string").alias("query"), F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null")
    rows = df.filter(F.col(column).isNotNull()).select(key, F.col(column).cast("array<double>").alias("_v"))
    kind = dict(df.dtypes)[key]
    schema = f"query string, `{key}` {kind}, distance double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    total = queries.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_numbers))
    found = None
    for b in range(blocks):
        asked = queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toPandas()
        if len(asked):
            shared = spark.sparkContext.broadcast((asked["query"].tolist(), _scaled(np.stack(asked["vector"].to_numpy()), metric)))
            part = rows.mapInArrow(_nearest_of(shared, k, metric, key, arrow), schema)
            part = written(part, "nearest") if blocks > 1 else part
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return found.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def _nearest_of(shared, k: int, metric: str, key: str, schema: pa.Schema):
    """For each query its k nearest rows of all batches: a row that is farther than the k-th so far is dropped at once."""

    def run(batches):
        names, q = pa.array(shared.value[0], pa.string()), shared.value[1]
        at, dist, keys = np.zeros(0, np.int64), np.zeros(0), None
        most = np.full(len(q), np.inf)  # the k-th distance so far
        for batch in batches:
            if not batch.num_rows:
                continue
            own, v = batch.column(0), batch.column(1)
            if pc.any(pc.not_equal(pc.list_value_length(v), q.shape[1])).as_py():
                raise QueryError(f"vectors have not all the {q.shape[1]} numbers of the query")
            v = _scaled(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), metric)
            parts = [(at, dist, keys)] if keys is not None else []
            for lo in range(0, len(q), 512):
                d = _distances(q[lo : lo + 512], v, metric)
                if d.shape[1] > k and np.isinf(most[lo : lo + 512]).any():
                    most[lo : lo + 512] = np.fmin(most[lo : lo + 512], np.partition(d, k - 1, 1)[:, k - 1])
                i, j = np.nonzero(d <= most[lo : lo + 512, None] + NEAR * np.maximum(1, np.abs(most[lo : lo + 512, None])))
                parts.append((i + lo, np.round(d[i, j], 9) + 0.0, own.take(pa.array(j))))
            at, dist = (np.concatenate(x) for x in list(zip(*parts))[:2])
            keys = pa.concat_arrays([x[2] for x in parts])
            by = pc.rank(keys, tiebreaker="dense").to_numpy()
            order = np.lexsort((by, dist, at))
            first = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            last = order[place == k - 1]
            most[at[last]] = dist[last]
            order = order[place < k]
            at, dist, keys = at[order], dist[order], keys.take(pa.array(order))
        if keys is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), keys, pa.array(dist)], schema=schema)

    return run


def _scaled(v: np.ndarray, metric: str) -> np.ndarray:
    """Vectors of length 1 for cosine, of 0 where they are 0."""
    if metric != "cosine":
        return v
    norm = np.linalg.norm(v, axis=1)[:, None]
    return v / np.where(norm == 0, 1, norm)


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Between all scaled vectors of both."""
    if metric == "l2":
        return np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * q @ v.T, 0)
    if metric == "dot":
        return -q @ v.T
    if metric == "l1":
        return np.stack([np.abs(v - x).sum(1) for x in q])
    d = q @ v.T
    return np.subtract(1, d, out=d)
