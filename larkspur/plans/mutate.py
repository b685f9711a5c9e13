"""Statements that change the catalog: rows, edges, schema, indexes, views and transactions.

A mutation puts another frame in the catalog. Conditions select rows as in SELECT; what a condition leaves unknown
stays. Literals become frames of the collection's types, and values of another type are refused before anything
changes.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import TYPES, Catalog, Collection, ColumnDef, EdgePart
from ..errors import QueryError
from ..functions import geo, scalar
from ..operators.relational import keep_unless, upsert
from ..scratch import written
from .lower import Lowering, Scope, lower_query, table_scope
from .parser import Parser, conjuncts, walk

MAX_INSERT_ROWS = 1_000_000
METHODS = {"btree", "hash", "gin", "gist", "bm25", "spatial", "hnsw", "search"}


class Changes:
    """What a statement touched."""

    def __init__(self):
        self.collections, self.keys, self.edge_types, self.count = set(), set(), set(), 0
        self.frames: list[DataFrame] = []  # (key) of rows that statements found, written


class Mutation:
    def __init__(self, spark, catalog: Catalog, params: list | None = None):
        self.spark, self.catalog, self.lw, self.changes = spark, catalog, Lowering(catalog, params), Changes()

    def run(self, text: str) -> int:
        p = Parser(text)
        t = p.now.word
        if t == "INSERT":
            p.next()
            self.insert_edges(p) if p.is_sign("(") else self.insert(p)
        elif t == "UPDATE":
            p.next()
            self.update_edges(p) if p.is_sign("(") else self.update(p)
        elif t == "DELETE":
            p.next()
            self.delete_edges(p) if p.is_sign("(") else self.delete(p)
        elif t == "MATCH":
            self.match_insert(p)
        elif t == "CREATE":
            self.create(p, text)
        elif t == "ALTER":
            self.alter(p)
        elif t in ("DROP", "REINDEX", "REFRESH"):
            self.drop(p)
        elif t in ("COMPACT", "SET", "VACUUM"):  # nothing here needs it
            return 0
        else:
            p.fail("a statement")
        return self.changes.count

    # rows
    def insert(self, p: Parser) -> None:
        p.need_word("INTO")
        name = p.table()
        p.need("(")
        columns = [p.name()]
        while p.sign(","):
            columns.append(p.name())
        p.need(")")
        p.need_word("VALUES")
        rows = []
        while True:
            p.need("(")
            values = p.expressions()
            p.need(")")
            if len(values) != len(columns):
                raise QueryError(f"{len(columns)} columns, {len(values)} values")
            rows.append({c: self.constant(v) for c, v in zip(columns, values)})
            if len(rows) > MAX_INSERT_ROWS:
                raise QueryError(f"INSERT takes {MAX_INSERT_ROWS} rows")
            if not p.sign(","):
                break
        p.end()
        self.put(name, rows)

    def constant(self, e: tuple):
        if e[0] == "call":
            match e[1]:
                case "UUIDV4":
                    return str(uuid.uuid4())
                case "UUIDV5":
                    return scalar.uuid5(self.lw.value(e[2][0]), self.lw.value(e[2][1]))
                case "NOW":
                    return int(time.time() * 1000)
                case "ST_GEOMFROMGEOJSON":
                    geo_text = self.lw.value(e[2][0])
                    json.loads(geo_text)
                    return geo_text
            raise QueryError(f"{e[1]} isn't a constant")
        return self.lw.value(e)

    def put(self, name: str, rows: list[dict]) -> None:
        """Rows by key: new ones, or in place of old ones."""
        coll = self.catalog.collections.get(name)
        now = int(time.time() * 1000)
        declared = {c.name: c for c in coll.columns} if coll and coll.columns else None
        kinds = dict(coll.df.dtypes) if coll else {}
        for r in rows:
            if declared:
                for c in declared.values():
                    if r.get(c.name) is None and c.default is not None:
                        r[c.name] = self.constant(c.default)
                    if r.get(c.name) is None and (c.name.endswith(("_at", "_time"))) and c.kind == "TIMESTAMPTZ":
                        r[c.name] = datetime.now(UTC).isoformat(timespec="seconds")
                    if r.get(c.name) is None and c.not_null and c.generated is None:
                        raise QueryError(f"{c.name} can't be NULL")
                for f in r:
                    if f != "_key" and f not in declared:
                        raise QueryError(f"{name} has no column {f}")
                r.setdefault("_created_unix", now)
                r["_updated_unix"] = now
            r["_key"] = str(r["_key"]) if r.get("_key") is not None else str(uuid.uuid4())
            for f, v in r.items():
                want = TYPES[declared[f].kind] if declared and f in declared else kinds.get(f) or self.guess([x.get(f) for x in rows])
                r[f] = self.fitted(f, v, want)
                kinds[f] = want
        kinds = {"_key": "string", **kinds}
        last = {r["_key"]: r for r in rows}  # the last of a key wins
        new = self.spark.createDataFrame([tuple(r.get(c) for c in kinds) for r in last.values()], ", ".join(f"`{c}` {k}" for c, k in kinds.items()))
        if declared:
            new = self.generated(new, name, coll.columns)
        if coll is None:
            self.catalog.collections[name] = Collection(self.cut(new))
        else:
            coll.df = self.cut(upsert(coll.df, new, ["_key"]))
        self.changes.collections.add(name)
        self.changes.keys |= {f"{name}/{k}" for k in last}
        self.changes.count += len(rows)

    def generated(self, df: DataFrame, name: str, columns: list[ColumnDef]) -> DataFrame:
        for c in columns:
            if c.generated is not None:
                scope = table_scope(df, name)
                scope.match = True  # missing parts of texts count as empty
                df = df.withColumn(c.name, self.lw.expr(c.generated, scope).cast(TYPES[c.kind]))
        return df

    @staticmethod
    def guess(values: list) -> str:
        v = next((v for v in values if v is not None), None)
        if isinstance(v, bool):
            return "boolean"
        if isinstance(v, (int, float)):
            return "double" if any(isinstance(x, float) for x in values) else "bigint"
        if isinstance(v, (list, tuple)):
            return "array<float>" if v and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v) else "array<string>" if all(isinstance(x, str) for x in v) else "string"
        return "string"

    @staticmethod
    def fitted(name: str, v, kind: str):
        """v as the column's type, or an error."""
        if v is None:
            return None
        if kind == "string":
            return v if isinstance(v, str) else json.dumps(v) if isinstance(v, (dict, list)) else json.dumps(v) if isinstance(v, bool) else str(v)
        if kind in ("bigint", "int") and isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer():
            return int(v)
        if kind in ("double", "float") and isinstance(v, (int, float)) and not isinstance(v, bool):
            return float(v)
        if kind == "boolean" and isinstance(v, bool):
            return v
        if kind.startswith("array"):
            v = json.loads(v) if isinstance(v, str) and v.startswith("[") else v
            if isinstance(v, (list, tuple)):
                return [float(x) for x in v] if "float" in kind or "double" in kind else [str(x) for x in v]
        raise QueryError(f"{name} is {kind}, got {v!r}")

    cuts = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Every mutation ends the lineage, so a frame never holds the plans of all that came before."""
        return written(df, "collection")

    def scope(self, name: str) -> tuple[DataFrame, Scope]:
        df = self.catalog.nodes(name)
        return df, table_scope(df, name)

    def selected(self, name: str, cond: tuple | None) -> DataFrame:
        df, scope = self.scope(name)
        return self.lw.filtered(df, scope, conjuncts(cond))

    def update(self, p: Parser) -> None:
        name = p.table()
        p.need_word("SET")
        sets = self.assignments(p)
        cond = p.expr() if p.word("WHERE") else None
        p.end()
        coll = self.catalog.collection(name)
        hit = written(self.selected(name, cond).select("_key"), "update")
        n = hit.count()
        if not n:
            return
        kinds = dict(coll.df.dtypes)
        declared = {c.name: c for c in coll.columns} if coll.columns else {}
        for f, v in sets.items():
            if declared and f not in declared:
                raise QueryError(f"{name} has no column {f}")
            sets[f] = self.fitted(f, v, kinds.get(f) or self.guess([v]))
            kinds.setdefault(f, self.guess([v]))
        rows = coll.df.join(hit, "_key", "left_semi").withColumns({f: lit(v).cast(kinds[f]) for f, v in sets.items()})
        if "_updated_unix" in kinds:
            rows = rows.withColumn("_updated_unix", F.lit(int(time.time() * 1000)))
        if coll.columns:
            rows = self.generated(rows, name, coll.columns)
        coll.df = self.cut(coll.df.join(hit, "_key", "left_anti").unionByName(rows, allowMissingColumns=True))
        self.note(name, hit, n)

    def note(self, name: str, hit: DataFrame, n: int) -> None:
        self.changes.collections.add(name)
        self.changes.count += n
        self.changes.frames.append(hit.select(F.concat(F.lit(f"{name}/"), "_key").alias("key")))

    def assignments(self, p: Parser) -> dict:
        sets = {}
        while True:
            f = p.name()
            if p.sign("."):
                f = p.name()
            p.need("=")
            sets[f] = self.constant(p.additive())
            if not p.sign(","):
                return sets

    def delete(self, p: Parser) -> None:
        p.need_word("FROM")
        names = sorted(self.catalog.collections) if p.word("ALL") else [p.table()]
        cond = p.expr() if p.word("WHERE") else None
        p.end()
        for name in names:
            coll = self.catalog.collection(name)
            if cond is not None and len(names) > 1 and not {x[1][-1] for x in walk(cond) if x[0] == "col"} <= {*coll.df.columns, "_id", "_collection"}:
                continue
            hit = written(self.selected(name, cond).select("_key"), "delete")
            n = hit.count()
            if n:
                self.remove(name, hit)
                self.note(name, hit, n)

    def remove(self, name: str, keys: DataFrame) -> None:
        """Rows by _key, and the edges at them."""
        coll = self.catalog.collection(name)
        coll.df = self.cut(coll.df.join(keys, "_key", "left_anti"))
        for parts in self.catalog.edges.values():
            for i, part in enumerate(parts):
                df = part.df
                for side, end in (("_src", part.source), ("_dst", part.target)):
                    if end == name:
                        df = df.join(keys.withColumnRenamed("_key", side), side, "left_anti")
                if df is not part.df:
                    parts[i] = EdgePart(part.source, part.target, self.cut(df.select(part.df.columns)), part.sound)

    # edges
    def endpoint(self, p: Parser) -> str:
        p.need("(")
        text = self.lw.value(p.primary())
        p.need(")")
        return text

    def edge(self, p: Parser) -> tuple[str, str, str, dict]:
        a = self.endpoint(p)
        h = p.hop()
        b = self.endpoint(p)
        if len(h.types) != 1 or h.direction == "both":
            raise QueryError("an edge has one type and one direction")
        a, b = (a, b) if h.direction == "out" else (b, a)
        return a, b, h.types[0], {k: self.constant(v) for k, v in h.props.items()}

    def insert_edges(self, p: Parser) -> None:
        edges = [self.edge(p)]
        while p.sign(","):
            edges.append(self.edge(p))
        p.end()
        self.link(edges)

    def link(self, edges: list[tuple[str, str, str, dict]]) -> None:
        """Edges with a _key replace the one of the same ends, type and _key; others are added."""
        groups: dict[tuple, list] = {}
        for a, b, t, attrs in edges:
            (ca, ka), (cb, kb) = split_slug(a), split_slug(b)
            groups.setdefault((t, ca, cb), []).append((ka, kb, attrs))
        for (t, ca, cb), rows in groups.items():
            names = list(dict.fromkeys(k for _, _, attrs in rows for k in attrs))
            part = next((q for q in self.catalog.edges.get(t, []) if (q.source, q.target) == (ca, cb)), None)
            kinds = {n: dict(part.df.dtypes).get(n) if part else None for n in names}
            kinds = {n: "string" if n == "_key" else k or self.guess([attrs.get(n) for _, _, attrs in rows]) for n, k in kinds.items()}
            data = [(ka, kb, *[self.fitted(n, attrs.get(n), kinds[n]) for n in names]) for ka, kb, attrs in rows]
            new = self.spark.createDataFrame(data, "_src string, _dst string" + "".join(f", `{n}` {k}" for n, k in kinds.items()))
            self.add_edges(t, ca, cb, new)
            self.changes.count += len(rows)

    def add_edges(self, t: str, source: str, target: str, new: DataFrame) -> None:
        parts = self.catalog.edges.setdefault(t, [])
        at = next((i for i, q in enumerate(parts) if (q.source, q.target) == (source, target)), None)
        if at is None:
            parts.append(EdgePart(source, target, self.cut(new)))
        else:
            old = parts[at].df
            if "_key" in new.columns and "_key" in old.columns:
                keyed = new.filter("_key is not null").select("_src", "_dst", "_key").distinct()
                old = old.join(keyed, ["_src", "_dst", "_key"], "left_anti")
            parts[at] = EdgePart(source, target, self.cut(old.unionByName(new, allowMissingColumns=True)), False)
        self.changes.edge_types.add(t)
        self.changes.collections |= {source, target}

    def edge_condition(self, part: EdgePart, a: str | None, b: str | None, props: dict, cond: tuple | None, var: str | None):
        """A Column for the edges meant, or None if the part has none of them."""
        test = F.lit(True)
        for side, end, slug_text in (("_src", part.source, a), ("_dst", part.target, b)):
            if slug_text is not None:
                c, k = split_slug(slug_text)
                if c != end:
                    return None
                test = test & (F.col(side) == k)
        for k, v in props.items():
            if k not in part.df.columns:
                return None
            test = test & (F.col(f"`{k}`") == F.lit(v))
        if cond is not None:
            columns = {(x, c) if x else (c,): (c, k) for c, k in part.df.dtypes for x in {None, var}}
            test = test & self.lw.expr(cond, Scope(part.df, columns))
        return test

    def change_edges(self, t: str, a: str, b: str, props: dict, cond: tuple | None, var: str | None, change) -> None:
        parts = self.catalog.edges.get(t, [])
        for i, part in enumerate(parts):
            test = self.edge_condition(part, a, b, props, cond, var)
            if test is None:
                continue
            n = part.df.filter(test).count()
            if n:
                parts[i] = EdgePart(part.source, part.target, self.cut(change(part.df, test)), part.sound)
                self.changes.count += n
                self.changes.edge_types.add(t)
                self.changes.collections |= {part.source, part.target}

    def ends(self, p: Parser):
        a = self.endpoint(p)
        h = p.hop()
        b = self.endpoint(p)
        a, b = (a, b) if h.direction == "out" else (b, a)
        return a, b, h.types[0], {k: self.constant(v) for k, v in h.props.items()}, h.var

    def delete_edges(self, p: Parser) -> None:
        a, b, t, props, var = self.ends(p)
        cond = p.expr() if p.word("WHERE") else None
        p.end()
        self.change_edges(t, a, b, props, cond, var, keep_unless)

    def update_edges(self, p: Parser) -> None:
        a, b, t, props, var = self.ends(p)
        p.need_word("SET")
        sets = self.assignments(p)
        cond = p.expr() if p.word("WHERE") else None
        p.end()
        self.change_edges(t, a, b, props, cond, var, lambda df, test: set_where(df, test, sets))

    def match_insert(self, p: Parser) -> None:
        """MATCH (p:c) [WHERE ...] INSERT (p)-[:t]->('x/y'), or the other way round."""
        p.need_word("MATCH")
        node = p.node()
        cond = p.expr() if p.word("WHERE") else None
        p.need_word("INSERT")

        def end():
            if p.peek().kind == "string":
                return self.endpoint(p)
            return p.node().var

        a = end()
        h = p.hop()
        b = end()
        p.end()
        if node.var not in (a, b):
            raise QueryError(f"the edge must start or end in {node.var}")
        cond = _bare(cond, node.var) if cond else None
        for k, v in node.props.items():
            same = ("op", "=", ("col", (k,)), v)
            cond = same if cond is None else ("and", cond, same)
        found = self.selected(node.label, cond).select("_key")
        attrs = {k: self.constant(v) for k, v in h.props.items()}
        other = b if a == node.var else a
        c, k = split_slug(other)
        new = found.select(F.col("_key").alias("n"), F.lit(k).alias("o"))
        out = (a == node.var) == (h.direction == "out")
        new = new.select(F.col("n" if out else "o").alias("_src"), F.col("o" if out else "n").alias("_dst"), *[lit(v).alias(f) for f, v in attrs.items()])
        new = written(new, "edges")
        self.add_edges(h.types[0], node.label if out else c, c if out else node.label, new)
        self.changes.count += new.count()

    # schema
    def create(self, p: Parser, text: str) -> None:
        p.next()
        if p.word("TABLE"):
            exists = p.word("IF", "NOT", "EXISTS")
            name = p.table()
            if name in self.catalog.collections:
                if exists:
                    return
                raise QueryError(f"{name} exists")
            p.need("(")
            columns = [self.column(p)]
            while p.sign(","):
                columns.append(self.column(p))
            p.need(")")
            if p.word("WITH"):  # indexes along with the table: WITH (hash_index = [a, b], ...)
                p.need("(")
                while not p.sign(")"):
                    method = {"range": "btree", "vector": "hnsw", "fulltext": "bm25"}.get(kind := p.name().removesuffix("_index"), kind)
                    p.need("=")
                    for field in p.literal()[1]:
                        self.catalog.indexes[f"{name}_{field[1][-1]}_{method}"] = (name, method, (field[1][-1],))
                    p.sign(",")
            p.end()
            self.catalog.collections[name] = Collection(self.empty(columns), columns)
        elif p.word("MATERIALIZED", "VIEW") or p.word("VIEW"):
            name = p.table()
            auto = False
            if p.word("WITH"):
                p.need("(")
                while not p.sign(")"):
                    auto = p.next().word == "TRUE" or auto
            p.need_word("AS")
            body = text[p.now.at :].rstrip().rstrip(";")
            self.catalog.collections[name] = Collection(self.materialised(body), body=body, auto_index=auto)
            if auto:
                for c, k in self.catalog.collections[name].df.dtypes:
                    method = "hnsw" if k.startswith("array") else "spatial" if c in ("geometry", "geo", "location") else "bm25" if k == "string" and c not in ("_key", "id") else None
                    if method:
                        self.catalog.indexes[f"{name}_{c}_{method}"] = (name, method, (c,))
        else:
            p.word("UNIQUE")
            p.need_word("INDEX")
            p.word("IF", "NOT", "EXISTS")
            title = None if p.now.word == "ON" else p.name()
            p.need_word("ON")
            coll = p.table()
            method = p.name().lower() if p.word("USING") else "btree"
            if method not in METHODS:
                raise QueryError(f"no index method {method}")
            p.need("(")
            fields = [p.name()]
            while p.sign(","):
                fields.append(p.name())
            p.need(")")
            p.end()
            df = self.catalog.collection(coll).df
            for f in fields:
                if self.catalog.collection(coll).columns and f not in df.columns:
                    raise QueryError(f"{coll} has no column {f}")
            self.catalog.indexes[title or f"{coll}_{'_'.join(fields)}_{method}"] = (coll, method, tuple(fields))
            if method in ("bm25", "search"):
                self.catalog.kept.add((coll, tuple(fields)))
                self.catalog.postings(coll, fields)

    def materialised(self, body: str) -> DataFrame:
        df = lower_query(self.catalog, body)
        key = F.col("_key") if "_key" in df.columns else F.col("id").cast("string") if "id" in df.columns else F.monotonically_increasing_id().cast("string")
        return self.cut(df.withColumn("_key", key))

    def column(self, p: Parser) -> ColumnDef:
        c = ColumnDef(p.name(), p.name().upper())
        if c.kind not in TYPES:
            raise QueryError(f"no type {c.kind}")
        while True:
            if p.word("PRIMARY", "KEY") or p.word("UNIQUE"):
                continue
            if p.word("NOT", "NULL"):
                c.not_null = c.name != "_key"
            elif p.word("DEFAULT"):
                c.default = p.primary() if not p.is_sign("-") else p.unary()
            elif p.word("GENERATED", "ALWAYS", "AS"):
                p.need("(")
                c.generated = p.expr()
                p.need(")")
                p.word("STORED")
            else:
                return c

    def empty(self, columns: list[ColumnDef]) -> DataFrame:
        kinds = {"_key": "string", **{c.name: TYPES[c.kind] for c in columns}, "_created_unix": "bigint", "_updated_unix": "bigint"}
        return self.spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in kinds.items()))

    def alter(self, p: Parser) -> None:
        p.next()
        p.need_word("TABLE")
        name = p.table()
        coll = self.catalog.collection(name)
        columns = coll.columns if coll.columns is not None else []
        if p.word("ADD"):
            p.word("COLUMN")
            c = self.column(p)
            value = lit(self.constant(c.default)) if c.default is not None else F.lit(None)
            coll.df = coll.df.withColumn(c.name, value.cast(TYPES[c.kind]))
            if coll.columns is not None:
                coll.columns = [*columns, c]
                coll.df = self.generated(coll.df, name, [c])
        elif p.word("DROP"):
            p.word("COLUMN")
            maybe = p.word("IF", "EXISTS")
            f = p.name()
            if f not in coll.df.columns and not maybe:
                raise QueryError(f"{name} has no column {f}")
            coll.df = coll.df.drop(f)
            coll.columns = [c for c in columns if c.name != f] if coll.columns is not None else None
        elif p.word("RENAME", "TO"):
            self.rename(name, p.name())
        elif p.word("RENAME"):
            p.word("COLUMN")
            old = p.name()
            p.need_word("TO")
            new = p.name()
            if old not in coll.df.columns:
                raise QueryError(f"{name} has no column {old}")
            coll.df = coll.df.withColumnRenamed(old, new)
            for c in columns:
                c.name = new if c.name == old else c.name
        else:
            p.need_word("ALTER")
            p.word("COLUMN")
            f = p.name()
            p.need_word("TYPE")
            kind = p.name().upper()
            if kind not in TYPES:
                raise QueryError(f"no type {kind}")
            coll.df = coll.df.withColumn(f, F.expr(f"try_cast(`{f}` as {TYPES[kind]})"))
            for c in columns:
                c.kind = kind if c.name == f else c.kind
        p.end()
        self.changes.collections.add(name)

    def rename(self, old: str, new: str) -> None:
        if new in self.catalog.collections:
            raise QueryError(f"{new} exists")
        self.catalog.collections[new] = self.catalog.collections.pop(old)
        for t, parts in self.catalog.edges.items():
            self.catalog.edges[t] = [EdgePart(new if q.source == old else q.source, new if q.target == old else q.target, q.df, q.sound) for q in parts]
        self.catalog.indexes = {n: (new if c == old else c, m, f) for n, (c, m, f) in self.catalog.indexes.items()}
        self.catalog.kept = {(new if c == old else c, f) for c, f in self.catalog.kept}

    def drop(self, p: Parser) -> None:
        what = p.next().word
        if what == "REINDEX":  # [[ON] collection [USING method] [(fields)]]; stored ones are built anew, the others are names
            coll, fields = None, None
            if not p.is_sign(";") and p.now.kind != "end":
                p.word("ON") or p.word("TABLE")
                coll = p.table()
                self.catalog.collection(coll)
                if p.word("USING"):
                    p.name()
                if p.sign("("):
                    fields = [p.name()]
                    while p.sign(","):
                        fields.append(p.name())
                    p.need(")")
            p.end()
            for name, own in self.catalog.kept:
                if coll in (None, name) and fields in (None, list(own)):
                    self.catalog.collection(name).postings.pop(own, None)
                    self.catalog.postings(name, own)
            return
        if what == "REFRESH":
            p.need_word("MATERIALIZED", "VIEW")
            coll = self.catalog.collection(p.table())
            p.end()
            if coll.body is None:
                raise QueryError("not a materialized view")
            coll.df = self.materialised(coll.body)
            return
        kind = p.next().word
        if kind == "MATERIALIZED":
            kind = p.next().word
        maybe = p.word("IF", "EXISTS")
        if kind in ("TABLE", "VIEW"):
            name = p.table()
            p.end()
            if name not in self.catalog.collections:
                if maybe:
                    return
                raise QueryError(f"no collection named {name}")
            del self.catalog.collections[name]
            self.catalog.edges = {t: q for t, parts in self.catalog.edges.items() if (q := [x for x in parts if name not in (x.source, x.target)])}
            self.catalog.indexes = {n: i for n, i in self.catalog.indexes.items() if i[0] != name}
            self.catalog.kept = {k for k in self.catalog.kept if k[0] != name}
            self.changes.collections.add(name)
            return
        if kind != "INDEX":
            p.fail("TABLE, VIEW or INDEX")
        title = None if p.now.word == "ON" else p.name()
        gone = [title] if title in self.catalog.indexes else []
        if p.word("ON"):
            coll = p.table()
            method = p.name().lower() if p.word("USING") else None
            fields = None
            if p.sign("("):
                fields = [p.name()]
                while p.sign(","):
                    fields.append(p.name())
                p.need(")")
            gone = gone or [n for n, (c, m, f) in self.catalog.indexes.items() if c == coll and method in (None, m) and (fields is None or tuple(fields) == f)]
        p.end()
        if not gone and not maybe:
            raise QueryError("no such index")
        for n in gone:
            coll, _, fields = self.catalog.indexes.pop(n)
            self.catalog.kept.discard((coll, fields))


def split_slug(text: str) -> tuple[str, str]:
    if "/" not in text:
        raise QueryError(f"{text!r} isn't collection/key")
    return tuple(text.split("/", 1))


def lit(v):
    return F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(json.dumps(v)) if isinstance(v, dict) else F.lit(v)


def set_where(df: DataFrame, test, sets: dict) -> DataFrame:
    kinds = dict(df.dtypes)
    hit = F.coalesce(test, F.lit(False))
    return df.withColumn("_hit", hit).withColumns({f: F.when(F.col("_hit"), lit(v).cast(kinds.get(f, Mutation.guess([v])))).otherwise(F.col(f"`{f}`") if f in kinds else F.lit(None)) for f, v in sets.items()}).drop("_hit")


def _bare(e, var: str):
    if isinstance(e, tuple) and e and e[0] == "col":
        return ("col", e[1][1:]) if len(e[1]) > 1 and e[1][0] == var else e
    if isinstance(e, tuple):
        return tuple(_bare(x, var) for x in e)
    return [_bare(x, var) for x in e] if isinstance(e, list) else e
