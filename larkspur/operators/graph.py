"""Walks, reachability and shortest paths over edges (src, dst): joins, and loops over whole frontiers.

Loops write each level to the shared folder, so plans stay small and a lost executor costs one level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..scratch import folder, written

LAZY_LEVELS = 6  # walks of fixed and small bounds stay one plan
MAX_DEPTH = 100_000
MOST_EDGES = 20_000


def checked(depth: int) -> int:
    if not 0 <= depth <= MAX_DEPTH:
        raise QueryError(f"walks go up to {MAX_DEPTH} edges")
    return depth


def oriented(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges as seen when walking: out, in or both."""
    flipped = edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst")
    return edges if direction == "out" else flipped.select(edges.columns) if direction == "in" else edges.unionByName(flipped)


def hop(frontier: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """frontier (node, ...) moved along one edge: node is the other end, the edges' attributes are added."""
    return frontier.join(oriented(edges, direction).withColumnRenamed("src", "node"), "node").drop("node").withColumnRenamed("dst", "node")


def bfs(starts: DataFrame, edges: DataFrame, depth: int, direction: str = "out", with_starts: bool = True) -> DataFrame:
    """(node, depth) of all nodes within `depth` edges of starts (node), each at its first depth.

    Without starts, a start counts only where it is reached again. What was seen is one growing table, so plans stay
    as they are however deep the walk.
    """
    spark = edges.sparkSession
    moves = oriented(edges.select("src", "dst"), direction)
    frontier = written(starts.select("node").distinct(), "frontier")
    path = f"{folder(spark)}/seen-{uuid.uuid4().hex}"
    if not with_starts:
        frontier.limit(0).withColumn("depth", F.lit(0)).write.parquet(path)
    else:
        frontier.withColumn("depth", F.lit(0)).write.parquet(path)
    seen = lambda: spark.read.schema("node string, depth int").parquet(path)
    for level in range(1, checked(depth) + 1):
        step = hop(frontier, moves).select("node").distinct().join(seen().select("node"), "node", "left_anti")
        frontier = written(step, "frontier")
        if frontier.isEmpty():
            break
        frontier.withColumn("depth", F.lit(level)).write.mode("append").parquet(path)
    return seen()


def leaves(nodes: DataFrame, edges: DataFrame, key: str = "_id") -> DataFrame:
    """Nodes without an edge out."""
    return nodes.join(edges.select(F.col("src").alias(key)).distinct(), key, "left_anti")


def roots(nodes: DataFrame, edges: DataFrame, key: str = "_id") -> DataFrame:
    """Nodes without an edge in."""
    return nodes.join(edges.select(F.col("dst").alias(key)).distinct(), key, "left_anti")


def count_walks(starts: DataFrame, edges: DataFrame, lo: int, hi: int, direction: str = "out") -> DataFrame:
    """(node, walks): how many walks of lo to hi edges end in each node.

    Counts are merged per node after every hop, so the work is one grouped join per level, not one row per walk.
    A walk in both directions never goes straight back.
    """
    moves = oriented(edges.select("src", "dst"), direction)
    both = direction == "both"
    kept = ["node"] + (["came"] if both else [])
    frontier = starts.groupBy("node").agg(F.count("*").alias("walks"))
    if both:
        frontier = frontier.withColumn("came", F.lit(None).cast("string"))
    total = frontier.select("node", "walks") if lo == 0 else None
    for level in range(1, checked(hi) + 1):
        step = frontier.join(moves.withColumnRenamed("src", "node"), "node")
        if both:
            step = step.filter(~F.col("dst").eqNullSafe(F.col("came"))).withColumn("came", F.col("node"))
        frontier = step.drop("node").withColumnRenamed("dst", "node").groupBy(*kept).agg(F.sum("walks").alias("walks"))
        if hi > LAZY_LEVELS:
            frontier = written(frontier, "walks")
            if frontier.isEmpty():
                break
        if level >= lo:
            part = frontier.select("node", "walks")
            total = part if total is None else total.unionByName(part)
    return (total if total is not None else frontier.select("node", "walks").limit(0)).groupBy("node").agg(F.sum("walks").alias("walks"))


def edge_collect(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(dst, edge): each node one hop from starts (node), with one of the edges that lead there, the least."""
    found = edges.join(starts.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    return found.groupBy("dst").agg(F.min(F.struct(*[c for c in edges.columns if c != "dst"])).alias("edge"))


def shortest_path(edges: DataFrame, start: str, goal: str, cap: int = MAX_DEPTH, most: int = MOST_EDGES) -> DataFrame:
    """(length, nodes, types): one row for the shortest directed walk over edges (src, dst, type), or none.

    Among equally short ones the lexicographically least sequence of nodes, then types, wins. The search goes from
    both ends, a level of the smaller frontier at a time. While a level has at most `most` edges it is kept on the
    driver, one light job a level; a wider one goes on as tables, from the start alone.
    """
    spark = edges.sparkSession
    schema = "length int, nodes array<string>, types array<string>"
    if start == goal:
        return spark.createDataFrame([(0, [start], [])], schema)
    sides = [_Side(start, "src", "dst"), _Side(goal, "dst", "src")]
    found: list[tuple[str, str, str]] = []
    for _ in range(cap):
        side = min(sides, key=lambda s: len(s.frontier))
        level = side.grow(edges, most)
        if level is None:
            return _shortest_in_tables(edges, start, goal, cap)
        found += level
        if not side.frontier:
            return spark.createDataFrame([], schema)
        if side.frontier & sides[side is sides[0]].depth.keys():
            return spark.createDataFrame([_least(found, sides, start)], schema)
    return spark.createDataFrame([], schema)


class _Side:
    """One end of a search: its frontier, and how far from it each node met so far is."""

    def __init__(self, node: str, near: str, far: str):
        self.frontier, self.depth, self.level, self.near, self.far = {node}, {node: 0}, 0, near, far

    def grow(self, edges: DataFrame, most: int) -> list[tuple[str, str, str]] | None:
        """The edges (src, dst, type) of the next level, or None if there are too many."""
        spark = edges.sparkSession
        here = F.broadcast(spark.createDataFrame([(n,) for n in sorted(self.frontier)], f"{self.near} string"))
        rows = [tuple(r) for r in edges.join(here, self.near).select("src", "dst", "type").limit(most + 1).collect()]
        if len(rows) > most:
            return None
        self.level += 1
        self.frontier = {r[self.far == "dst"] for r in rows} - self.depth.keys()
        self.depth |= dict.fromkeys(self.frontier, self.level)
        return rows


def _least(found: list[tuple[str, str, str]], sides: list[_Side], start: str) -> tuple[int, list[str], list[str]]:
    """Of the shortest walks over the edges found, the least."""
    ahead, behind = sides
    total = ahead.level + behind.level
    out: dict[str, set] = {}
    for a, b, t in found:
        out.setdefault(a, set()).add((b, t))
    paths = {start: ((start, ""),)}
    for i in range(1, total + 1):
        grown: dict[str, tuple] = {}
        for node, path in paths.items():
            for b, t in out.get(node, ()):
                if (ahead.depth.get(b) == i) if i < ahead.level else (behind.depth.get(b) == total - i):
                    grown[b] = min(grown.get(b, ((chr(0x10FFFF), ""),)), (*path, (b, t)))
        paths = grown
    (path,) = paths.values()
    return total, [n for n, _ in path], [t for _, t in path[1:]]


def _shortest_in_tables(edges: DataFrame, start: str, goal: str, cap: int) -> DataFrame:
    """The same from the start alone, every level a table; levels stop as soon as the goal or nothing new is reached."""
    spark = edges.sparkSession
    step_type = "array<struct<node:string,type:string>>"
    frontier = spark.range(1).select(F.lit(start).alias("node"), F.array(F.struct(F.lit(start).alias("node"), F.lit("").alias("type"))).cast(step_type).alias("path"))
    path = f"{folder(spark)}/seen-{uuid.uuid4().hex}"
    frontier.select("node").write.parquet(path)
    for _ in range(cap):
        seen = spark.read.schema("node string").parquet(path)
        grown = F.concat("path", F.array(F.struct(F.col("dst").alias("node"), F.col("type").alias("type"))))
        step = frontier.join(edges.select(F.col("src").alias("node"), "dst", "type"), "node").select(F.col("dst").alias("node"), grown.cast(step_type).alias("path"))
        frontier = written(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")), "frontier")
        if frontier.isEmpty() or not frontier.filter(F.col("node") == goal).isEmpty():
            break
        frontier.select("node").write.mode("append").parquet(path)
    found = frontier.filter(F.col("node") == goal)
    return found.select((F.size("path") - 1).alias("length"), F.col("path.node").alias("nodes"), F.slice(F.col("path.type"), F.lit(2), F.size("path") - 1).alias("types"))
