"""A chain of steps on one frame: filters, traversals, sets, rankings, and typed-query verbs."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .functions import geo, vector
from .functions.nulls import ordered
from .operators import graph, relational
from .operators import text as text_ops
from .operators import vector as vector_ops

if TYPE_CHECKING:
    from .engine import Engine


class Q:
    """Every step gives a new Q; collect(), count(), first() and exists() run it."""

    def __init__(self, engine: Engine, df: DataFrame, name: str | None = None, ranks: tuple[Column, ...] = ()):
        self.engine, self.df, self.name, self.ranks = engine, df, name, ranks

    def _with(self, df: DataFrame, name: str | None = None, ranks: tuple[Column, ...] | None = None) -> Q:
        return Q(self.engine, df, name or self.name, self.ranks if ranks is None else ranks)

    # filters
    def where(self, condition: Column) -> Q:
        return self._with(self.df.filter(condition))

    def where_eq(self, f: str, v) -> Q:
        return self.where(F.col(f) == v)

    def where_neq(self, f: str, v) -> Q:
        return self.where(F.col(f) != v)

    def where_gt(self, f: str, v) -> Q:
        return self.where(F.col(f) > v)

    def where_lt(self, f: str, v) -> Q:
        return self.where(F.col(f) < v)

    def where_gte(self, f: str, v) -> Q:
        return self.where(F.col(f) >= v)

    def where_lte(self, f: str, v) -> Q:
        return self.where(F.col(f) <= v)

    def where_between(self, f: str, lo, hi) -> Q:
        return self.where(F.col(f).between(lo, hi))

    def where_in(self, f: str, values: list) -> Q:
        return self.where(F.col(f).isin(*values))

    def like(self, f: str, needle: str) -> Q:
        """A plain substring; % and _ stand for themselves."""
        return self.where(F.contains(F.col(f), F.lit(needle)))

    def ilike(self, f: str, needle: str) -> Q:
        return self.where(F.contains(F.lower(F.col(f)), F.lit(needle.lower())))

    def near(self, f: str, lon: float, lat: float, metres: float) -> Q:
        box, exact = geo.dwithin(F.col(f), lon, lat, metres)
        return self._with(self.df.filter(box).filter(exact))

    def match_text(self, f: str, terms: str) -> Q:
        df = text_ops.bm25_scored(self.df, f, terms, "_match", self.engine.catalog.collection(self.name).df if self.name else None)
        return self._with(df.filter("_match > 0").drop("_match"))

    # traversal
    def _edges(self, kind: str | None) -> DataFrame:
        e = self.engine.edges([kind] if kind else None)
        return e.select(F.col("from").alias("src"), F.col("to").alias("dst"), "type", "attrs")

    def _at(self, ids: DataFrame, kind: str | None = None) -> Q:
        """The nodes of a frame (node), once each; kind says what edges led there, so in which collections they are."""
        cat = self.engine.catalog
        ends = {c for _, p in cat.parts([kind] if kind else None) for c in (p.source, p.target)} | ({self.name} if self.name else set(cat.collections))
        every = cat.every(sorted(ends & set(cat.collections)))
        return Q(self.engine, every.join(ids.select(F.col("node").alias("_id")).distinct(), "_id", "left_semi"))

    def forward(self, kind: str) -> Q:
        return self._at(graph.hop(self.df.select(F.col("_id").alias("node")), self._edges(kind).select("src", "dst")), kind)

    def backward(self, kind: str) -> Q:
        return self._at(graph.hop(self.df.select(F.col("_id").alias("node")), self._edges(kind).select("src", "dst"), "in"), kind)

    def hops(self, n: int) -> Q:
        """All nodes within n edges of any type, the starts too."""
        return self._at(graph.bfs(self.df.select(F.col("_id").alias("node")), self._edges(None), n))

    def hops_typed(self, kind: str, n: int) -> Q:
        """Nodes within n edges of a type; starts only if reached again."""
        return self._at(graph.bfs(self.df.select(F.col("_id").alias("node")), self._edges(kind), n, with_starts=False), kind)

    def leaves(self) -> Q:
        return self._with(graph.leaves(self.df, self._edges(None)))

    def roots(self) -> Q:
        return self._with(graph.roots(self.df, self._edges(None)))

    def edge_collect(self, kind: str) -> DataFrame:
        return graph.edge_collect(self.df.select(F.col("_id").alias("node")), self._edges(kind))

    # sets
    def intersect(self, other: Q) -> Q:
        return self._with(relational.intersect(self.df, other.df))

    def subtract(self, other: Q) -> Q:
        return self._with(relational.subtract(self.df, other.df))

    def union(self, other: Q) -> Q:
        return self._with(relational.union(self.df, other.df))

    # order
    def sort(self, f: str, descending: bool = False) -> Q:
        return self._with(self.df.orderBy(ordered(F.col(f), descending), "_id"))

    sort_by = sort

    def nearest(self, f: str, query: list[float], k: int, metric: str = "cosine") -> Q:
        return self._with(vector_ops.nearest(self.df, f, query, k, metric).drop("_distance"))

    def rank_by_text(self, f: str, terms: str, weight: float = 1.0, normalized: bool = True) -> Q:
        name = f"_rank{len(self.ranks)}"
        df = text_ops.bm25_scored(self.df, f, terms, name, self.engine.catalog.collection(self.name).df if self.name else None)
        score = text_ops.bm25_norm(F.col(name)) if normalized else F.col(name)
        return self._with(df, ranks=(*self.ranks, score * weight))

    def rank_by_vector(self, f: str, query: list[float], metric: str = "cosine", weight: float = 1.0) -> Q:
        fn = vector.FUNCTIONS["VECTOR_DOT" if metric == "dot" else "VECTOR_COSINE"]
        return self._with(self.df, ranks=(*self.ranks, F.coalesce(fn(F.col(f), vector.literal(query)), F.lit(0.0)) * weight))

    def frame(self) -> DataFrame:
        """The rows, ranked if there are ranks."""
        df = self.df
        if self.ranks:
            df = df.withColumn("_score", sum(self.ranks[1:], self.ranks[0])).orderBy(F.desc("_score"), "_id")
            df = df.drop("_score", *[f"_rank{i}" for i in range(len(self.ranks))])
        return df

    def skip(self, n: int) -> Q:
        return Q(self.engine, self.frame().offset(n), self.name)

    offset = skip

    def take(self, n: int) -> Q:
        return Q(self.engine, self.frame().limit(n), self.name)

    limit = take

    def select(self, *fields: str) -> Q:
        return self._with(self.frame().select("_id", *[f for f in fields if f != "_id"]), ranks=())

    # ends
    def collect(self) -> list[Row]:
        return self.frame().collect()

    find = collect

    def first(self) -> Row | None:
        return self.frame().first()

    find_first = first

    def count(self) -> int:
        return self.df.count()

    def exists(self) -> bool:
        return not self.df.isEmpty()

    def update(self, **sets) -> int:
        """Set fields of all rows; each collection's rows change in one statement."""
        keys = self.df.select("_key")
        return self.engine._mutate(lambda m: _update(m, self.name, keys, sets))

    def delete_all(self) -> int:
        keys = self.df.select("_key")

        def change(m):
            from .scratch import written

            hit = written(keys, "delete")
            n = hit.count()
            m.remove(self.name, hit)
            m.note(self.name, hit, n)

        return self.engine._mutate(change)


def _update(m, name: str, keys: DataFrame, sets: dict) -> None:
    from .plans.mutate import lit
    from .scratch import written

    hit = written(keys, "update")
    coll = m.catalog.collection(name)
    kinds = dict(coll.df.dtypes)
    new = {f: lit(m.fitted(f, v, kinds.get(f) or m.guess([v]))).cast(kinds.get(f) or m.guess([v])) for f, v in sets.items()}
    rows = coll.df.join(hit, "_key", "left_semi").withColumns(new)
    coll.df = m.cut(coll.df.join(hit, "_key", "left_anti").unionByName(rows, allowMissingColumns=True))
    m.note(name, hit, hit.count())
