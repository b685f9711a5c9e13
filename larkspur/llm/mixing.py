"""Mixing sources to target weights that vary over training: a curriculum as an inverted integral.

Each source has a weight at every time t of training, from 0 to 1. The shares p_s(t) = w_s(t) / sum of all
weights are integrated over STEPS equal steps (midpoint rule) to the cumulative demand D_s(t) = budget * integral
of p_s, in tokens. Within a source the documents stand in the order of a hash of their doc_id; the document whose
middle token is the source's c-th is due when D_s reaches c, so its training position is the inverse of D_s at c.
Sorting by position gives a stream whose mixture follows the weights at every time, while supplies last.

The budget is the tokens of all documents, and each document is used once. A source with less supply than demand
ends before t = 1; what a source has beyond its demand follows at the rate of its last step, at positions above 1.

The default weights go from each source's share of the tokens (t = 0) to the square root of it (t = 1): small
sources gain as training goes on. Other schedules: weights={source: (start, end)}; a source without one gets no
weight in (0, 1], and all its documents a position of 2.

Tokens are words: blanks (space, tab, newline) + 1, none in empty or NULL text. The running totals are two-level
(sums of hash ranges of a source, then rows within a range), and there are as many ranges as keep one at RANGE_ROWS
rows, so no task holds a whole source at any size.

Defined results: a NULL source is the source ''. A row without a doc_id stands where the hash of its text puts it. Repeated rows each
get a position of their own. Very long texts only have many tokens. Without tokens of a source its documents get its first position. An empty table gives
no rows. Columns of any other names stay as they are.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

STEPS = 64
RANGE_ROWS = 50_000


def curriculum(docs: DataFrame, weights: dict[str, tuple[float, float]] | None = None, carry: list[str] | None = None) -> DataFrame:
    """docs' rows, or their columns `carry`, as a struct `row`, with `_tokens` and their training position `_at`, in no order."""
    # as many ranges of the hash as keep a range of a source at about RANGE_ROWS rows
    ranges = max(1, ceil(docs.count() / RANGE_ROWS))
    row = F.struct("*") if carry is None else F.struct(*carry)
    rows = docs.select(row.alias("row"), F.xxhash64("text").alias("_key"), *_keys(ranges))
    sums = common.written(docs.select(*_keys(ranges)).groupBy("_source", "_range").agg(F.sum("_tokens").alias("_sum")), "ranges")
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_range")) - F.col("_sum")).drop("_sum")
    demand = _demand(sums.groupBy("_source").agg(F.sum("_sum").alias("_supply")), weights)
    inside = Window.partitionBy("_source", "_range").orderBy("_hash", "_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("_upto", F.sum("_tokens").over(inside))
        .join(before, ["_source", "_range"])
        .withColumn("_c", F.col("_before") + F.col("_upto") - F.col("_tokens") / 2.0)
        .join(demand, "_source")
    )
    step = F.least(F.size(F.filter("_due", lambda d: d <= F.col("_c"))) - 1, F.lit(STEPS - 1))
    lo, hi = F.get("_due", F.col("_step")), F.get("_due", F.col("_step") + 1)
    at = F.when(hi > lo, (F.col("_step") + (F.col("_c") - lo) / (hi - lo)) / STEPS).otherwise(F.lit(2.0))
    return placed.withColumn("_step", step).withColumn("_at", F.round(at, 6)).select("row", "_source", "_tokens", "_at")


def _keys(ranges: int) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.when(F.length(text) > 0, F.length(text) - F.length(F.translate(text, " \t\n", "")) + 1).otherwise(0)
    hashed = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.md5(text.cast("binary")))
    number = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    place = F.floor(number / 2**32 * ranges)
    return [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), hashed.alias("_hash"), place.alias("_range"), tokens.cast("bigint").alias("_tokens")]


def _demand(supply: DataFrame, weights: dict[str, tuple[float, float]] | None) -> DataFrame:
    """(_source, _due): the cumulative demand of each source at the STEPS + 1 knots, in tokens."""
    total = supply.agg(F.sum("_supply").cast("double").alias("_total"))
    ends = supply.crossJoin(total).withColumn("_q", F.when(F.col("_total") > 0, F.col("_supply") / F.col("_total")).otherwise(0.0))
    if weights is None:
        ends = ends.withColumn("_w0", F.col("_q")).withColumn("_w1", F.sqrt("_q"))
    else:
        given = F.create_map(*[F.lit(x) for s, (a, b) in weights.items() for x in (s, F.array(F.lit(float(a)), F.lit(float(b))))]) if weights else F.create_map().cast("map<string,array<double>>")
        pair = F.try_element_at(given, F.col("_source"))
        ends = ends.withColumn("_w0", F.coalesce(F.get(pair, F.lit(0)), F.lit(0.0))).withColumn("_w1", F.coalesce(F.get(pair, F.lit(1)), F.lit(0.0)))
    knots = ends.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
    t = (F.col("_k") + 0.5) / STEPS
    knots = knots.withColumn("_w", (1 - t) * F.col("_w0") + t * F.col("_w1"))
    sums = knots.groupBy("_k").agg(F.sum("_w").alias("_all"))
    share = knots.join(sums, "_k").withColumn("_d", F.when(F.col("_all") > 0, F.col("_total") * F.col("_w") / F.col("_all") / STEPS).otherwise(0.0))
    upto = F.sum("_d").over(Window.partitionBy("_source").orderBy("_k"))
    ordered = share.withColumn("_due", upto).groupBy("_source").agg(F.array_sort(F.collect_list("_due")).alias("_due"))
    return ordered.withColumn("_due", F.concat(F.array(F.lit(0.0)), "_due"))


def in_training_order(docs: DataFrame, weights: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """docs' rows and columns, range-sorted by training position."""
    return curriculum(docs, weights).orderBy("_at", F.col("row.doc_id")).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    placed = curriculum(docs, carry=["doc_id"])
    return placed.select("row.doc_id", F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_at").alias("position")).orderBy("position", "doc_id")


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(cast(doc_id AS varchar)) AS h,
         CASE WHEN length(text) > 0 THEN length(text) - length(translate(text, ' ' || chr(9) || chr(10), '')) + 1 ELSE 0 END AS n_tokens
  FROM documents),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - n_tokens / 2.0 AS c FROM d),
s AS (SELECT source, sum(n_tokens) AS supply, sum(sum(n_tokens)) OVER () AS total FROM d GROUP BY source),
k AS (SELECT source, k, total, (1 - (k + 0.5) / {STEPS}) * (supply / total) + (k + 0.5) / {STEPS} * sqrt(supply / total) AS w FROM s, range({STEPS}) r(k)),
p AS (SELECT source, k, total * w / (sum(w) OVER (PARTITION BY k)) / {STEPS} AS step FROM k),
b AS (SELECT source, k, sum(step) OVER (PARTITION BY source ORDER BY k) - step AS lo, sum(step) OVER (PARTITION BY source ORDER BY k) AS hi FROM p)
SELECT c.doc_id, c.source, cast(c.n_tokens AS bigint) AS n_tokens, round((b.k + (c.c - b.lo) / (b.hi - b.lo)) / {STEPS}, 6) AS position
FROM c JOIN b ON c.source = b.source AND ((c.c >= b.lo AND c.c < b.hi) OR (b.k = {STEPS - 1} AND c.c >= b.hi))
"""
