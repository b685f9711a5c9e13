"""The engine: a catalog, SQL in and DataFrames out, and the calls that don't need SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .builder import Q
from .catalog import Catalog, Collection, EdgePart, slug
from .errors import QueryError
from .operators import text as text_ops
from .plans.lower import Lowering, lower_query
from .plans.mutate import Changes, Mutation, split_slug
from .plans.parser import Parser, Select, parse_select
from .session import ready


class Engine:
    """register() and register_edges() take any DataFrames; sql() reads, execute() changes.

    Nothing runs until a DataFrame is acted on. Snapshots are copies of the catalog: frames never change.
    """

    def __init__(self, spark: SparkSession, read_only: bool = False):
        self.spark, self.read_only = ready(spark), read_only
        self.catalog = Catalog()
        self._base: Catalog | None = None  # before BEGIN
        self._pending: list[Changes] = []
        self._listeners: dict[int, Callable[[dict], None]] = {}
        self._bulk = False

    # what is there
    def register(self, name: str, df: DataFrame | Callable[[], DataFrame], key: str | None = None) -> Engine:
        """A collection from a DataFrame, or a function that gives it when needed; key is the column that names rows."""

        def made() -> DataFrame:
            got = df if isinstance(df, DataFrame) else df()
            if key:
                return got.withColumn("_key", F.col(f"`{key}`").cast("string"))
            if "_key" not in got.columns:
                raise QueryError("a collection needs _key, or a column to make it from")
            return got

        self.catalog.collections[name] = Collection(made() if isinstance(df, DataFrame) else made, key=key)
        return self

    def register_edges(self, kind: str, source: str, target: str, df: DataFrame | Callable[[], DataFrame], src: str, dst: str, sound: bool = False) -> Engine:
        """Edges from a DataFrame: src and dst are columns with keys, all others attributes.

        sound promises that both ends exist, as after a foreign key; else joins prove it.
        """

        def made() -> DataFrame:
            got = df if isinstance(df, DataFrame) else df()
            return got.withColumns({"_src": F.col(f"`{src}`").cast("string"), "_dst": F.col(f"`{dst}`").cast("string")}).drop(*[c for c in (src, dst) if c not in ("_src", "_dst")])

        self.catalog.edges.setdefault(kind, []).append(EdgePart(source, target, made() if isinstance(df, DataFrame) else made, sound))
        return self

    def index(self, collection: str, method: str, *fields: str, stored: bool = False) -> Engine:
        """Allow queries that need an index; a stored bm25 or search index is built when it is first used."""
        self.catalog.indexes[f"{collection}_{'_'.join(fields)}_{method}"] = (collection, method, fields)
        if stored and method in ("bm25", "search"):
            self.catalog.kept.add((collection, fields))
        return self

    def collection_names(self) -> list[str]:
        return sorted(self.catalog.collections)

    def node_count(self) -> int:
        return sum(c.df.count() for c in self.catalog.collections.values())

    def edge_count(self) -> int:
        return sum(p.df.count() for parts in self.catalog.edges.values() for p in parts)

    def stats(self) -> dict[str, int]:
        return {"nodes": self.node_count(), "edges": self.edge_count(), "collections": len(self.catalog.collections), "edge_types": len(self.catalog.edges)}

    def all_slugs(self) -> DataFrame:
        return self.catalog.every().select("_id")

    def edge_schema(self) -> list[tuple[str, str, str]]:
        return sorted((p.source, t, p.target) for t, parts in self.catalog.edges.items() for p in parts)

    def table_schema(self, name: str) -> list[tuple[str, str]]:
        return self.catalog.collection(name).df.dtypes

    def schema_ddl(self, name: str) -> str | None:
        """CREATE TABLE of a collection, declared or inferred."""
        coll = self.catalog.collections.get(name)
        if coll is None:
            return None
        if coll.columns is not None:
            cols = [f"{c.name} {c.kind}" + (" NOT NULL" if c.not_null else "") for c in coll.columns]
        else:
            back = {"string": "TEXT", "bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOL", "array<float>": "VECTOR", "array<double>": "VECTOR"}
            cols = [f"{c} {back.get(k, 'TIMESTAMPTZ' if k.startswith('timestamp') else 'JSON')}" + (" PRIMARY KEY" if c == "_key" else "") for c, k in coll.df.dtypes if c not in ("_created_unix", "_updated_unix")]
        return f"CREATE TABLE {name} ({', '.join(cols)})"

    # SQL
    def sql(self, text: str, params: list | None = None) -> DataFrame:
        """SELECT or SHOW."""
        first = text.lstrip()[:4].upper()
        return self.show(text) if first == "SHOW" else lower_query(self.catalog, text, params)

    query = sql

    def prepare(self, text: str) -> Select:
        """Parsed once, to be run with different parameters."""
        return parse_select(text)

    def query_prepared(self, prepared: Select, params: list | None = None) -> DataFrame:
        return Lowering(self.catalog, params).select(prepared)

    def explain(self, text: str, params: list | None = None, analyze: bool = False) -> str:
        """Spark's formatted plan; analyze runs the query first, so that it is the plan that adaptive execution chose."""
        df = self.sql(text, params)
        if analyze:
            df._jdf.queryExecution().toRdd().count()
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def execute(self, text: str, params: list | None = None) -> int:
        """A statement that changes something; how many rows or edges it changed."""
        word = Parser(text).now.word
        if word in ("BEGIN", "COMMIT", "ROLLBACK"):
            return self._transaction(word)
        return self._mutate(lambda m: m.run(text), params)

    def _mutate(self, change: Callable[[Mutation], object], params: list | None = None) -> int:
        if self.read_only:
            raise QueryError("the engine is read-only")
        draft = self.catalog.snapshot()
        m = Mutation(self.spark, draft, params)
        change(m)
        self.catalog = draft
        c = m.changes
        if c.collections or c.edge_types:
            self._pending.append(c)
            if self._base is None:
                self._publish()
        return c.count

    def _transaction(self, word: str) -> int:
        if word == "BEGIN":
            if self._base is not None:
                raise QueryError("a transaction is open")
            self._base = self.catalog.snapshot()
        elif self._base is None:
            raise QueryError("no transaction is open")
        elif word == "ROLLBACK":
            self.catalog, self._base, self._pending = self._base, None, []
        else:
            self._base = None
            self._publish()
        return 0

    @contextmanager
    def transaction(self):
        """All changes within, or none if an error leaves it."""
        self._transaction("BEGIN")
        try:
            yield self
        except BaseException:
            self._transaction("ROLLBACK")
            raise
        self._transaction("COMMIT")

    def _publish(self) -> None:
        """One event for all that was committed together."""
        if self._pending:
            changes, self._pending = self._pending, []
            if self._listeners:  # keys are only fetched if somebody listens
                keys = {k for c in changes for k in c.keys} | {r[0] for c in changes for f in c.frames for r in f.toLocalIterator()}
                event = {"collections": sorted({x for c in changes for x in c.collections}), "keys": sorted(keys), "edge_types": sorted({x for c in changes for x in c.edge_types})}
                for f in list(self._listeners.values()):
                    f(event)

    def subscribe_changes(self, listener: Callable[[dict], None]) -> int:
        number = max(self._listeners, default=0) + 1
        self._listeners[number] = listener
        return number

    def unsubscribe_changes(self, number: int) -> None:
        self._listeners.pop(number, None)

    def watch(self, text: str, on_rows: Callable[[list[Row]], None], params: list | None = None) -> Callable[[], None]:
        """The result now and after each commit; call what it returns to end."""
        run = lambda _=None: on_rows(self.sql(text, params).collect())
        run()
        number = self.subscribe_changes(run)
        return lambda: self.unsubscribe_changes(number)

    def snapshot(self) -> Engine:
        """A read-only engine on the data as it is now."""
        e = Engine(self.spark, read_only=True)
        e.catalog = self.catalog.snapshot()
        return e

    def show(self, text: str) -> DataFrame:
        """SHOW TABLES | EDGES [FROM c] [TO c] | TABLE t | CREATE [TABLE] t | t."""
        p = Parser(text)
        p.need_word("SHOW")
        rows = lambda data, schema: self.spark.createDataFrame(data, schema)
        if p.word("TABLES"):
            return self._counted([((n,), self.catalog.collections[n].df) for n in self.collection_names()], ["name"])
        if p.word("EDGES"):
            a = p.name() if p.word("FROM") else None
            b = p.name() if p.word("TO") else None
            parts = [((q.source, t, q.target), q.df) for t, found in sorted(self.catalog.edges.items()) for q in found if a in (None, q.source) and b in (None, q.target)]
            return self._counted(parts, ["from", "type", "to"])
        if p.word("CREATE"):
            p.word("TABLE")
            return rows([(self.schema_ddl(p.table()),)], "ddl string")
        if p.word("INDEXES"):
            return rows([(n, c, m, ",".join(f)) for n, (c, m, f) in sorted(self.catalog.indexes.items())], "name string, collection string, method string, fields string")
        p.word("TABLE")
        return rows(self.table_schema(p.table()), "column string, type string")

    def _counted(self, named: list[tuple[tuple, DataFrame]], columns: list[str]) -> DataFrame:
        """Names with how many rows each frame has."""
        out = None
        for names, df in named:
            row = df.agg(F.count("*").alias("count")).select(*[F.lit(n).alias(c) for c, n in zip(columns, names)], "count")
            out = row if out is None else out.unionByName(row)
        return out if out is not None else self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns) + ", count bigint")

    @property
    def frames(self):
        """pandas in and out."""
        from .sources.frames import Frames

        return Frames(self)

    # rows and edges by slug
    def put(self, key: str, record: dict | str) -> None:
        self.put_many([(key, record)])

    def put_many(self, pairs: list[tuple[str, dict | str]]) -> int:
        def change(m: Mutation):
            groups: dict[str, list[dict]] = {}
            for key, record in pairs:
                c, k = split_slug(key)
                groups.setdefault(c, []).append({**(json.loads(record) if isinstance(record, str) else record), "_key": k})
            for c, rows in groups.items():
                m.put(c, rows)

        return self._mutate(change)

    def begin_bulk(self) -> None:
        self._transaction("BEGIN")

    def end_bulk(self) -> None:
        self._transaction("COMMIT")

    def get(self, key: str) -> dict | None:
        c, k = split_slug(key)
        if c not in self.catalog.collections:
            return None
        row = self.catalog.collection(c).df.filter(F.col("_key") == k).first()
        return row.asDict(True) if row is not None else None

    def contains(self, key: str) -> bool:
        return self.get(key) is not None

    def remove(self, key: str) -> int:
        c, k = split_slug(key)
        return self.execute(f"DELETE FROM {c} WHERE _key = $1", [k])

    def put_vector(self, key: str, field: str, data: list[float]) -> None:
        self.put(key, {**(self.get(key) or {}), field: [float(x) for x in data]})

    def get_vector(self, key: str, field: str) -> list[float] | None:
        return (self.get(key) or {}).get(field)

    def vector_dim(self, collection: str, field: str) -> int | None:
        row = self.catalog.collection(collection).df.filter(F.col(field).isNotNull()).select(F.size(field)).first()
        return row[0] if row is not None else None

    def link(self, a: str, b: str, kind: str, **attrs) -> None:
        self._mutate(lambda m: m.link([(a, b, kind, attrs)]))

    def link_meta(self, a: str, b: str, kind: str, meta: dict | str) -> None:
        self.link(a, b, kind, **(json.loads(meta) if isinstance(meta, str) else meta))

    def link_many(self, edges: list[tuple]) -> int:
        """(from, to, type) or (from, to, type, attributes)."""
        return self._mutate(lambda m: m.link([(*e[:3], e[3] if len(e) > 3 else {}) for e in edges]))

    link_meta_many = link_many

    def unlink(self, a: str, b: str, kind: str) -> int:
        return self.unlink_where(a, b, kind, {})

    def unlink_where(self, a: str, b: str, kind: str, props: dict) -> int:
        from .operators.relational import keep_unless

        return self._mutate(lambda m: m.change_edges(kind, a, b, props, None, None, keep_unless))

    def update_edge(self, a: str, b: str, kind: str, props: dict, sets: dict) -> int:
        from .plans.mutate import set_where

        return self._mutate(lambda m: m.change_edges(kind, a, b, props, None, None, lambda df, t: set_where(df, t, sets)))

    def edges(self, types: list[str] | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
        """(from, to, type, attrs) with the attributes as JSON."""
        return self._edges(self.catalog.parts(types, {source} if source else None, {target} if target else None))

    def _edges(self, parts: list[tuple[str, EdgePart]]) -> DataFrame:
        out = None
        for t, p in parts:
            attrs = [c for c in p.df.columns if c not in ("_src", "_dst")]
            df = p.df.select(slug(p.source, F.col("_src")).alias("from"), slug(p.target, F.col("_dst")).alias("to"), F.lit(t).alias("type"), (F.to_json(F.struct(*attrs)) if attrs else F.lit("{}")).alias("attrs"))
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], "`from` string, `to` string, type string, attrs string")

    def edges_from(self, key: str) -> DataFrame:
        return self.edges(source=split_slug(key)[0]).filter(F.col("from") == key)

    def edges_to(self, key: str) -> DataFrame:
        return self.edges(target=split_slug(key)[0]).filter(F.col("to") == key)

    def edges_from_collection(self, name: str) -> DataFrame:
        return self.edges(source=name)

    def edges_between(self, a: str, b: str) -> DataFrame:
        return self.edges(source=a, target=b)

    def edge_types_from(self, key: str) -> list[str]:
        return sorted(r[0] for r in self.edges_from(key).select("type").distinct().collect())

    def edge_types_from_collection(self, name: str) -> list[str]:
        return sorted({t for t, p in self.catalog.parts(None, {name})})

    # builders
    def collection(self, name: str) -> Q:
        return Q(self, self.catalog.nodes(name), name)

    def one(self, key: str) -> Q:
        c, k = split_slug(key)
        return Q(self, self.catalog.nodes(c).filter(F.col("_key") == k), c)

    def many(self, keys: list[str]) -> Q:
        names = sorted({split_slug(k)[0] for k in keys} & set(self.catalog.collections))
        return Q(self, self.catalog.every(names or None).filter(F.col("_id").isin(*keys)))

    def all(self) -> Q:
        return Q(self, self.catalog.every())

    def bm25_search(self, collection: str, field: str, query: str, k: int) -> DataFrame:
        return text_ops.bm25_search(self.catalog.nodes(collection), field, query, k, postings=self.catalog.postings(collection, [field]))

    def ilike(self, collection: str, field: str, needle: str) -> DataFrame:
        return self.catalog.nodes(collection).filter(F.contains(F.lower(field), F.lit(needle.lower())))

    gin_ilike = ilike

    def shortest_path(self, a: str, b: str) -> DataFrame:
        """(length, nodes, types), or no row."""
        from .operators.graph import shortest_path

        edges = self._edges(self.catalog.between(split_slug(a)[0], split_slug(b)[0]))
        return shortest_path(edges.select(F.col("from").alias("src"), F.col("to").alias("dst"), "type"), a, b)

    bfs_shortest_path = shortest_path

    def bfs_shortest_len(self, a: str, b: str) -> int | None:
        row = self.shortest_path(a, b).first()
        return row["length"] if row is not None else None

    def centroid(self, key: str) -> str | None:
        from .functions import geo

        c, k = split_slug(key)
        row = self.catalog.collection(c).df.filter(F.col("_key") == k).select(geo.centroid(F.col("geometry"))).first()
        return row[0] if row is not None else None

    def dump_sql(self) -> list[str]:
        from .sources.dump import dump_sql

        return list(dump_sql(self))

    def load_sql(self, statements: list[str]) -> int:
        from .sources.dump import load_sql

        return load_sql(self, iter(statements))

    def memory_report(self) -> dict[str, int]:
        """Bytes of cached blocks; the engine itself caches nothing."""
        return {"storage": sum(i.memSize() for i in self.spark._jsc.sc().getRDDStorageInfo())}

    # nothing to do for Spark
    def compact(self) -> None: ...

    def sync(self) -> None: ...

    def trim_memory(self) -> None: ...

    def set_hnsw_ef_search(self, ef: int | None) -> None: ...

    def close(self) -> None: ...

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()


