"""Groups of similar items: bands of sketches, stars within buckets, verification, connected components.

Buckets aren't paired off. The least item of a bucket is its pivot and every other one is verified against it, so a
bucket of n copies costs n - 1 comparisons. Then the components of the edges so far are taken: a bucket within one
component is done, and of any other the next 2, 4, 8 ... items are pivots in turn, each verified against all later
items of other components, whether those matched an earlier pivot or not. Once the pairs across components that are
left in all buckets are fewer than the items that came in, they are all compared. So every pair of a bucket is
verified or already in one component, and no bucket is cut or skipped, whatever its size.

No task sorts a bucket or a group: least items and roots come from aggregates, which combine before the shuffle, the
few pivots of a round from a limited rank (each task keeps only as many of a bucket as there are pivots), and the rest
are joins by bucket, which adaptive execution splits where one bucket is large.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def similar_stars(members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Verified edges (a, b) of members (bucket, item); verify takes and gives pairs (a, b)."""
    edges: DataFrame | None = None
    lots, width = None, 1
    members = members.select("bucket", "item", F.col("item").alias("root"))
    while True:
        # buckets within one component have nothing left to find
        open_ = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
        left = common.written(members.join(open_, "bucket", "left_semi"), "buckets")
        inside = left.groupBy("bucket", "root").count().groupBy("bucket").agg(F.sum("count").alias("n"), F.sum(F.col("count").cast("double") * F.col("count")).alias("same"))
        n, buckets, pairs = inside.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum((F.col("n").cast("double") * F.col("n") - F.col("same")) / 2), F.lit(0.0))).first()
        if not n:
            return edges
        rest = lots is not None and pairs <= lots
        lots = n - buckets if lots is None else lots
        first = left if rest else left.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("item"))).filter(F.col("place") <= width)
        pivots = first.select("bucket", F.col("item").alias("a"), F.col("root").alias("ra"))
        pivots = pivots if rest else common.written(pivots, "pivots")
        others = left.select("bucket", F.col("item").alias("b"), F.col("root").alias("rb"))
        found = common.written(verify(pivots.join(others, "bucket").filter("a < b and ra <> rb").select("a", "b").distinct()), "edges")
        edges = found if edges is None else edges.unionByName(found)
        if rest:
            return edges
        last = pivots.groupBy("bucket").agg(F.max("a").alias("last"))
        later = left.join(last, "bucket").filter("item > last").select("bucket", "item")
        members = later.join(components(edges), "item", "left").withColumn("root", F.coalesce("root", "item"))
        width *= 2


def components(edges: DataFrame) -> DataFrame:
    """(item, root) of each item that has an edge (a, b); the root is the least item of its component.

    Large stars and small stars in turn (Kiveris et al., 2014): O(log n) rounds in practice, each written. The least
    neighbour is an aggregate joined back, so an item with many edges isn't gathered in one task.
    """
    state = None
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = common.written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        edges = common.written(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("item"), F.col("b").alias("root"))
        state = now


def grouped(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    """rows (doc_id, key, item) with `root`: the item's component, or itself; NULL items have none."""
    if edges is None:
        return rows.withColumn("root", F.col("item"))
    return rows.join(components(edges), "item", "left").withColumn("root", F.coalesce("root", "item"))


def with_kept(groups: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more, kept_doc_id): the least doc_id of each row's group; a row without an item is alone."""
    rows = common.written(groups.select("doc_id", "root", *more), "groups")
    kept = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("kept_doc_id"))
    lone = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("kept_doc_id"))
    return rows.join(kept, "root", "left").select("doc_id", *more, lone.alias("kept_doc_id"))


def kept_rows(groups: DataFrame) -> DataFrame:
    """(_id, _key) of the row that stays of each group: the least doc_id (NULL last), among its rows the least key."""
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("_id"), F.col("key").alias("_key")))
    of_groups = groups.filter("root is not null").groupBy("root").agg(least.alias("row")).select("row._id", "row._key")
    return of_groups.unionByName(groups.filter("root is null").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")))
