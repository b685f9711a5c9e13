"""Lowering: syntax trees to Columns and DataFrames.

A Scope says what names mean. Scores that need the whole corpus (BM25, SEARCH) become columns of the frame before
the expression that uses them is made; everything else is an expression. Catalyst does the rest.

Where this differs from the older dialect, it does so on purpose: arithmetic has the usual precedence, comparisons
of text and times are ordered as such, predicates in NOT and OR are evaluated, GROUP BY comes before LIMIT, a
label on a destination holds, and an empty set stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..errors import QueryError
from ..functions import geo, scalar, vector
from ..functions.nulls import number, ordered, safe_div, score_ordered
from ..operators import text as text_ops
from ..operators import vector as vector_ops
from .parser import Select, conjuncts, parse_select, walk

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}
PATH_FOLDS = {"PATH_SUM", "PATH_AVG", "PATH_MIN", "PATH_MAX", "PATH_PRODUCT", "PATH_FIRST", "PATH_LAST"}
SCORES = {"BM25", "BM25_NORM", "SEARCH_SCORE", "ST_DISTANCE", *vector.FUNCTIONS}
MAX_ROWS = 2**31 - 1
MAX_VECTOR_K, MAX_SUBSTRING = 1_000_000, 100_000_000


@dataclass
class Scope:
    """columns: name parts -> (column of the frame, type). In a match, names are (variable, field)."""

    frame: DataFrame
    columns: dict[tuple, tuple[str, str]]
    match: bool = False
    corpora: dict = field(default_factory=dict)  # variable or '' -> (collection name, frame)
    nodes: dict[str, str] = field(default_factory=dict)  # variable -> column of the whole node
    aliases: dict[str, tuple] = field(default_factory=dict)
    local: dict[str, Column] = field(default_factory=dict)

    def find(self, parts: tuple) -> tuple[Column, str]:
        if parts[0] in self.local:
            c = self.local[parts[0]]
            for p in parts[1:]:
                c = c[p]
            return c, "string"
        if parts in self.columns:
            name, kind = self.columns[parts]
            return F.col(f"`{name}`"), kind
        for cut in range(len(parts) - 1, 0, -1):  # a field within a struct
            if parts[:cut] in self.columns and self.columns[parts[:cut]][1].startswith("struct"):
                name, _ = self.columns[parts[:cut]]
                c = F.col(f"`{name}`")
                for p in parts[cut:]:
                    c = c[p]
                return c, "string"
        raise QueryError(f"no column {'.'.join(parts)}")


def table_scope(df: DataFrame, name: str, alias: str | None = None) -> Scope:
    columns = {}
    for c, kind in df.dtypes:
        columns[(c,)] = (c, kind)
        for prefix in {alias or name, name}:
            columns[(prefix, c)] = (c, kind)
    return Scope(df, columns, corpora={"": (name, df)})


class Lowering:
    """One statement's lowering: the catalog, its parameters, and the frame as it grows columns."""

    def __init__(self, catalog: Catalog, params: list | None = None):
        self.catalog, self.params, self.made = catalog, params or [], {}

    @property
    def spark(self):
        return SparkSession.active()

    # values
    def param(self, n: int):
        if not 1 <= n <= len(self.params):
            raise QueryError(f"no parameter ${n}")
        return self.params[n - 1]

    def value(self, e: tuple):
        """A constant: of a literal, a parameter, or a list of such."""
        match e[0]:
            case "lit":
                return e[1]
            case "param":
                return self.param(e[1])
            case "neg":
                return -self.value(e[1])
            case "array":
                return [self.value(x) for x in e[1]]
            case "object":
                return {k: self.value(x) for k, x in e[1].items()}
            case "point":
                return {"type": "Point", "coordinates": [e[1], e[2]]}
            case "polygon":
                return {"type": "Polygon", "coordinates": [[list(p) for p in e[1]]]}
        raise QueryError("expected a constant")

    def vector(self, e: tuple) -> list[float]:
        v = self.value(e)
        if not isinstance(v, (list, tuple)) or not v:
            raise QueryError("expected a vector")
        return [float(x) for x in v]

    def point(self, e: tuple) -> tuple[float, float]:
        if e[0] == "point":
            return e[1], e[2]
        if e[0] == "call" and e[1] == "ST_GEOMFROMGEOJSON":
            import json

            shape = json.loads(self.value(e[2][0]))
            if shape.get("type") == "Point":
                return tuple(shape["coordinates"][:2])
        raise QueryError("expected POINT(lon lat)")

    def polygon(self, e: tuple) -> list[tuple[float, float]]:
        if e[0] == "polygon":
            return e[1]
        if e[0] == "call" and e[1] == "ST_GEOMFROMGEOJSON":
            return geo.parse_polygon(self.value(e[2][0]))
        raise QueryError("expected a polygon")

    # expressions
    def kind(self, e: tuple, scope: Scope) -> str:
        if e[0] == "col":
            return scope.find(e[1])[1]
        return "string"

    def score(self, scope: Scope, e: tuple, score: bool = True) -> Column:
        return number(self.expr(e, scope)) if e[0] == "col" and score else self.expr(e, scope)

    def expr(self, e: tuple, scope: Scope) -> Column:
        go = lambda x: self.expr(x, scope)
        match e[0]:
            case "lit" | "param":
                v = self.value(e)
                return F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
            case "array":
                return F.array(*[go(x) for x in e[1]])
            case "col":
                if len(e[1]) == 1 and e[1][0] in scope.nodes and (e[1][0],) not in scope.columns:
                    return F.col(f"`{scope.nodes[e[1][0]]}`")
                return scope.find(e[1])[0]
            case "path":
                return scalar.json_path(go(e[1]), e[2], self.kind(e[1], scope), e[3])
            case "neg":
                return -go(e[1])
            case "not":
                return ~go(e[1])
            case "and":
                return go(e[1]) & go(e[2])
            case "or":
                return go(e[1]) | go(e[2])
            case "null":
                return go(e[1]).isNotNull() if e[2] else go(e[1]).isNull()
            case "between":
                x, (lo, hi) = go(e[1]), (self.like_kind(y, e[1], scope) for y in e[2:4])
                return (x >= lo) & (x <= hi)
            case "in":
                found = go(e[1]).isin(*[self.like_kind(x, e[1], scope) for x in e[2]]) if e[2] else F.lit(False)
                return ~found if e[3] else found
            case "any":
                if e[2][0] in ("param", "array"):
                    return go(e[1]).isin(*[F.lit(x) for x in self.value(e[2])]) if self.value(e[2]) else F.lit(False)
                return F.array_contains(go(e[2]), go(e[1]))
            case "contains":
                return scalar.contains_all(go(e[1]), [F.lit(x) for x in self.value(e[2])])
            case "like":
                pattern = self.value(e[2])
                return F.ilike(go(e[1]), F.lit(pattern)) if e[3] else F.like(go(e[1]), F.lit(pattern))
            case "case":
                out = None
                for cond, then in e[1]:
                    out = (F if out is None else out).when(go(cond), go(then))
                return out.otherwise(go(e[2]))
            case "op":
                return self.operator(e, scope)
            case "quant":
                return self.quantified(e, scope)
            case "call":
                return self.call(e, scope)
            case "star":
                raise QueryError("* stands alone")
        raise QueryError(f"{e[0]} has no place here")

    def like_kind(self, e: tuple, other: tuple, scope: Scope) -> Column:
        """A constant as what it is compared with: text with a time becomes a time."""
        if e[0] in ("lit", "param") and isinstance(self.value(e), str):
            kind = self.kind(other, scope) if other[0] == "col" else ""
            if kind.startswith(("timestamp", "date")):
                return F.lit(self.value(e)).cast(kind)
        return self.expr(e, scope)

    def operator(self, e: tuple, scope: Scope) -> Column:
        _, sign, a, b = e
        if sign in vector.OPERATORS:
            q = self.vector(b)
            return vector.OPERATORS[sign](self.expr(a, scope), vector.literal(q))
        if sign == "||":
            parts = [self.expr(a, scope), self.expr(b, scope)]
            return scalar.concat(*parts) if scope.match else F.concat(*[p.cast("string") for p in parts])
        if sign in ("+", "-", "*", "/"):
            x, y = self.score(scope, a, self.scoring), self.score(scope, b, self.scoring)
            return safe_div(x, y) if sign == "/" else {"+": x + y, "-": x - y, "*": x * y}[sign]
        x, y = (self.now(o, scope) if e_key(t) == e_key(NOW) else self.like_kind(t, o, scope) for t, o in ((a, b), (b, a)))
        return {"=": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[sign]()

    def now(self, other: tuple, scope: Scope) -> Column:
        """NOW() in a comparison: an instant beside instants, else milliseconds, in a match seconds, since 1970."""
        if other[0] == "col" and scope.find(other[1])[1].startswith(("timestamp", "date")):
            return F.current_timestamp()
        return F.unix_timestamp(F.current_timestamp()) if scope.match else F.unix_millis(F.current_timestamp())

    scoring = False  # whether missing fields in arithmetic count as 0

    def quantified(self, e: tuple, scope: Scope) -> Column:
        _, kind, var, array, cond = e

        def test(x: Column) -> Column:
            inner = Scope(scope.frame, scope.columns, scope.match, scope.corpora, scope.nodes, scope.aliases, {**scope.local, var: x})
            return F.coalesce(self.expr(cond, inner), F.lit(False))

        a = self.expr(array, scope)
        if kind == "ANY":
            return F.exists(a, test)
        if kind == "ALL":
            return F.forall(a, test)
        return F.size(F.filter(a, test)) == (0 if kind == "NONE" else 1)

    def call(self, e: tuple, scope: Scope) -> Column:
        _, name, args, distinct = e
        go = lambda i: self.expr(args[i], scope)
        if e_key(e) in self.made:
            return F.col(f"`{self.made[e_key(e)]}`")
        if name in AGGREGATES:
            return self.aggregate(e, scope)
        if name in PATH_FOLDS:
            return path_fold(name, go(0))
        if name in ("LENGTH", "LEN", "NODES", "RELATIONSHIPS") and args and args[0][0] == "col" and len(args[0][1]) == 1 and (args[0][1][0], "nodes") in scope.columns:
            path = args[0][1][0]
            if name == "NODES":
                return scope.find((path, "nodes"))[0]
            if name == "RELATIONSHIPS":
                return scope.find((path, "rels"))[0]
            return F.size(scope.find((path, "nodes"))[0]) - 1
        if name in ("LENGTH", "LEN"):
            return scalar.length(go(0))
        if name in ("LOWER", "UPPER"):
            return getattr(F, name.lower())(go(0))
        if name in ("TRIM", "LTRIM", "RTRIM"):
            return scalar.trim(go(0), name != "RTRIM", name != "LTRIM")
        if name in ("SUBSTRING", "SUBSTR"):
            size = self.value(args[2]) if len(args) > 2 else MAX_ROWS
            if len(args) > 2 and size > MAX_SUBSTRING:
                raise QueryError(f"SUBSTRING takes up to {MAX_SUBSTRING} characters")
            return scalar.substring(go(0), self.value(args[1]), size)
        if name == "REPLACE":
            return F.replace(go(0), go(1), go(2))
        if name == "CONCAT":
            return scalar.concat(*[go(i) for i in range(len(args))])
        if name == "CONCAT_WS":
            return scalar.concat_ws(self.value(args[0]), *[go(i) for i in range(1, len(args))])
        if name == "COALESCE":
            parts = [go(i) for i in range(len(args))]
            return scalar.coalesce(*parts)
        if name == "NOW":
            return scalar.now_text()
        if name in ("AGE_DAYS", "AGE_HOURS"):
            return scalar.age(go(0), 86400 if name == "AGE_DAYS" else 3600, self.kind(args[0], scope))
        if name in scalar.DATE_PARTS:
            return scalar.date_part(name, go(0), self.kind(args[0], scope))
        if name == "DATE_TRUNC":
            return scalar.date_trunc(self.value(args[0]), go(1), self.kind(args[1], scope))
        if name == "JSON_ARRAY_LENGTH":
            return scalar.json_array_length(go(0), self.kind(args[0], scope))
        if name == "UUIDV4":
            return scalar.uuid4()
        if name == "UUIDV5":
            return F.lit(scalar.uuid5(self.value(args[0]), self.value(args[1])))
        if name in vector.FUNCTIONS:
            return F.coalesce(vector.FUNCTIONS[name](go(0), vector.literal(self.vector(args[1]))), F.lit(0.0))
        if name.startswith("ST_"):
            return self.spatial(name, args, scope)
        raise QueryError(f"no function {name}")

    def spatial(self, name: str, args: list[tuple], scope: Scope) -> Column:
        g = self.expr(args[0], scope) if args[0][0] != "lit" else F.lit(self.value(args[0]))
        measures = {"ST_LENGTH": geo.length, "ST_PERIMETER": geo.perimeter, "ST_AREA": geo.area, "ST_CENTROID": geo.centroid, "ST_ASGEOJSON": lambda x: x, "ST_GEOMFROMGEOJSON": lambda x: x}
        if name in measures:
            m = measures[name](g)
            return F.coalesce(m > self.value(args[1]), F.lit(False)) if len(args) > 1 else m
        if name == "ST_DISTANCE":
            d = geo.distance(g, *self.point(args[1]))
            return F.coalesce(d < self.value(args[2]), F.lit(False)) if len(args) > 2 else F.coalesce(d, F.lit(1.7976931348623157e308))
        if name == "ST_DWITHIN":
            near, exact = geo.dwithin(g, *self.point(args[1]), float(self.value(args[2])))
            return F.coalesce(near, F.lit(False)) & exact
        shape = args[1]
        if name == "ST_CONTAINS":
            if shape[0] == "point" or shape[0] == "call" and '"Point"' in str(self.value(shape[2][0])):
                return geo.contains_point(g, *self.point(shape))
            return geo.contains_polygon(g, self.polygon(shape))
        if name == "ST_WITHIN":
            return geo.within_polygon(g, self.polygon(shape))
        if name == "ST_INTERSECTS":
            return geo.intersects_polygon(g, self.polygon(shape))
        raise QueryError(f"no function {name}")

    def aggregate(self, e: tuple, scope: Scope) -> Column:
        """In a match, a missing number counts as 0, SUM of nothing is 0 and COUNT(x.f) counts rows."""
        _, name, args, distinct = e
        if name == "COUNT":
            if distinct:
                return F.count_distinct(self.expr(args[0], scope))
            if "_w" in scope.frame.columns:
                return F.coalesce(F.sum("_w"), F.lit(0)).cast("bigint")
            return F.count("*") if not args or args[0][0] == "star" or scope.match else F.count(self.expr(args[0], scope))
        if scope.match and name in ("SUM", "AVG"):
            old, self.scoring = self.scoring, True
            x = number(self.expr(args[0], scope))
            self.scoring = old
            total = F.sum(x)
            return F.coalesce(total, F.lit(0.0)) if name == "SUM" else total / F.nullif(F.count("*"), F.lit(0))
        old, self.scoring = self.scoring, scope.match
        x = self.expr(args[0], scope)
        self.scoring = old
        return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](x)

    # columns that need the corpus
    def prepare(self, df: DataFrame, scope: Scope, exprs: list[tuple]) -> DataFrame:
        """df with a column for each BM25, SEARCH and SEARCH_SCORE among the expressions."""
        for e in [x for ex in exprs for x in walk(ex)]:
            if e[0] != "call" or e[1] not in ("BM25", "BM25_NORM", "SEARCH", "SEARCH_SCORE") or e_key(e) in self.made:
                continue
            _, name, args, _ = e
            out = f"_s{len(self.made)}"
            if name in ("BM25", "BM25_NORM"):
                c = args[0][1]
                coll, corpus = self.corpus(scope, c[0] if scope.match else "")
                if coll and not self.catalog.has_index(coll, "bm25", c[-1]):
                    raise QueryError(f"BM25 needs a bm25 index on {coll}({c[-1]})")
                column = scope.columns[c][0] if c in scope.columns else None
                if column is None:
                    raise QueryError(f"no column {'.'.join(c)}")
                query = self.value(args[1])
                key, stored = self.stored(scope, c[0] if scope.match else "", coll, [c[-1]])
                df = text_ops.bm25_scored(df, column, query, out, corpus.withColumnRenamed(c[-1], column) if column != c[-1] else corpus, stored, key)
                if name == "BM25_NORM":
                    df = df.withColumn(out, text_ops.bm25_norm(F.col(out), float(self.value(args[2])) if len(args) > 2 else 1.0))
            else:
                var = next(iter(scope.corpora)) if scope.match else ""
                coll, corpus = self.corpus(scope, var)
                fields = self.catalog.search_fields(coll)
                names = [scope.columns[(var, f) if scope.match else (f,)][0] for f in fields]
                texts = [a for a in args if a[0] != "typo"]
                query = self.value(texts[0]) if texts else self.search_text
                if query is None:
                    raise QueryError("SEARCH_SCORE() needs a SEARCH")
                if name == "SEARCH":
                    self.search_text = query
                    typo = next((a[1] for a in args if a[0] == "typo"), None)
                    key, stored = self.stored(scope, var, coll, fields)
                    df = text_ops.search_matched(df, names, query, out, typo, corpus.withColumnsRenamed(dict(zip(fields, names))) if names != fields else corpus, stored, key)
                else:
                    df = text_ops.search_scored(df, names, query, out)
            self.made[e_key(e)] = out
        return df

    search_text: str | None = None

    def stored(self, scope: Scope, var: str, coll: str | None, fields: list[str]):
        """The column with the keys of a collection's rows, and its stored index if there is one and the keys are there."""
        key = scope.columns.get((var, "_key") if scope.match else ("_key",), (None,))[0]
        return (key, self.catalog.postings(coll, fields)) if key and coll and coll != "ALL" else ("_key", None)

    def corpus(self, scope: Scope, var: str) -> tuple[str, DataFrame]:
        if var not in scope.corpora:
            raise QueryError(f"no collection for {var}")
        return scope.corpora[var]

    def keyed(self, df: DataFrame, name: str, conds: list[tuple]) -> DataFrame:
        """df with conditions on _key also said of the number it was made from, which the scan can use."""
        number_ = self.catalog.collection(name).number
        plain = lambda x: x[0] in ("lit", "param") and str(self.value(x)).isdigit() and str(int(self.value(x))) == str(self.value(x))
        for c in conds if number_ else []:
            if c[0] == "in":
                if all(plain(x) for x in c[2]):
                    df = df.filter(F.col(f"`{number_}`").isin([int(self.value(x)) for x in c[2]]))
                continue
            if c[1] == "=" and plain(c[3]):
                df = df.filter(F.col(f"`{number_}`") == int(self.value(c[3])))
        return df

    # SELECT from one collection
    def select(self, s: Select) -> DataFrame:
        from . import match

        if s.graph or s.stages or len(s.sources) > 1 or s.sources[0].pattern:
            return match.lower(self, s)
        if s.union:
            raise QueryError("UNION is for MATCH queries")
        src = s.sources[0]
        name = src.name or "ALL"
        df = self.catalog.nodes(src.name) if src.name else self.catalog.every()
        scope = table_scope(df, name, src.alias)
        if src.name:
            df = self.keyed(df, src.name, [c for c in conjuncts(s.where) if is_key(c) or c[0] == "in" and not c[3] and c[2] and c[1][0] == "col" and c[1][1][-1] == "_key"])
        df = self.filtered(df, scope, conjuncts(s.where))
        return self.finish(s, df, scope)

    def filtered(self, df: DataFrame, scope: Scope, conds: list[tuple]) -> DataFrame:
        """WHERE; the nearest k of VECTOR_NEAR are taken before the other conditions, but after a key or a place."""
        near = [c for c in conds if c[0] == "call" and c[1] == "VECTOR_NEAR"]
        rest = [c for c in conds if c not in near]
        first = [c for c in rest if is_key(c) or c[0] == "call" and c[1] in ("ST_DWITHIN", "ST_DISTANCE")] if near else rest
        df = self.apply(df, scope, first)
        for c in near:
            column = scope.columns[c[2][0][1]][0]
            query, k = self.vector(c[2][1]), int(self.value(c[2][2]))
            if not 0 <= k <= MAX_VECTOR_K:
                raise QueryError(f"VECTOR_NEAR takes up to {MAX_VECTOR_K} rows")
            vector_ops.check_width(scope.frame, column, query)
            df = vector_ops.nearest(df, column, query, k, "cosine", scope.columns.get(("_key",), ("_key", ""))[0]).drop("_distance")
        return self.apply(df, scope, [c for c in rest if c not in first]) if near else df

    def apply(self, df: DataFrame, scope: Scope, conds: list[tuple]) -> DataFrame:
        df = self.prepare(df, scope, conds)
        for c in conds:
            if c[0] == "call" and c[1] == "ST_DWITHIN":  # the box test as a filter of its own, below the Python step
                near, exact = geo.dwithin(self.expr(c[2][0], scope), *self.point(c[2][1]), float(self.value(c[2][2])))
                df = df.filter(near).filter(exact)
            else:
                df = df.filter(self.expr(c, scope))
        return df

    def finish(self, s: Select, df: DataFrame, scope: Scope) -> DataFrame:
        """Grouping, projection, DISTINCT, order and limits."""
        scope.aliases = {a: e for e, a in s.items if a}
        exprs = [e for e, _ in s.items] + [e for e, _ in s.order] + ([s.having] if s.having else []) + s.group
        for e in [x for ex in exprs for x in walk(ex) if x[0] == "op" and x[1] in vector.OPERATORS or x[0] == "call" and x[1] in vector.FUNCTIONS]:
            target = e[2] if e[0] == "op" else e[2][0]
            q = e[3] if e[0] == "op" else e[2][1]
            if target[0] == "col" and target[1] in scope.columns:
                vector_ops.check_width(scope.frame, scope.columns[target[1]][0], self.vector(q))
        df = self.prepare(df, scope, exprs)
        scope = Scope(df, scope.columns, scope.match, scope.corpora, scope.nodes, scope.aliases)
        if s.group or any(x[0] == "call" and x[1] in AGGREGATES for e, _ in s.items for x in walk(e)):
            return self.limited(s, self.grouped(s, df, scope))
        outputs = self.outputs(s, df, scope)
        keys, tie = self.order_keys(s, scope, [n for _, n in outputs])
        if s.distinct:
            df = df.select(*[c.alias(n) for c, n in outputs]).distinct()
            flat = Scope(df, {(n,): (n, k) for n, k in df.dtypes}, scope.match)
            named = {repr(e): n for (e, _), (_, n) in zip([i for i in s.items if i[0][0] != "star"], outputs)} if not any(e[0] == "star" for e, _ in s.items) else {}
            keys = [(lambda c=F.col(f"`{named[repr(e)]}`") if repr(e) in named else self.expr(e, flat): ordered(c, bool(d)))() for e, d in s.order]
            return self.limited(s, df.orderBy(*keys) if keys else df)
        temp = [(f"_o{i}", k) for i, k in enumerate(keys)]
        df = df.select(*[c.alias(n) for c, n in outputs], *[k[0].alias(n) for n, k in temp], *([F.col(f"`{tie}`").alias("_tie")] if tie and (temp or s.limit or s.offset) else []))
        if temp:
            df = df.orderBy(*[k[1](F.col(n)) for n, k in temp], *(["_tie"] if "_tie" in df.columns else []))
        elif "_tie" in df.columns:
            df = df.orderBy("_tie")
        return self.limited(s, df).drop("_tie", *[n for n, _ in temp])

    def outputs(self, s: Select, df: DataFrame, scope: Scope) -> list[tuple[Column, str]]:
        out = []
        for e, alias in s.items:
            if e[0] == "star":
                for n in self.star(e[1], df, scope):
                    out.append((F.col(f"`{n[0]}`"), n[1]))
            else:
                out.append((self.expr(e, scope), alias or default_name(e)))
        return out

    def star(self, prefix: str | None, df: DataFrame, scope: Scope) -> list[tuple[str, str]]:
        if scope.match:
            found = [(c, parts[1]) for parts, (c, _) in scope.columns.items() if parts[0] == prefix and len(parts) == 2]
            if prefix is None:
                found = [(c, parts[1]) for parts, (c, _) in scope.columns.items() if len(parts) == 2]
            return [(c, n) for c, n in found if n not in ("_id", "_collection")]
        return [(c, c) for c in scope.frame.columns if c not in ("_id", "_collection") and not c.startswith("_s") and (c,) in scope.columns]

    def order_keys(self, s: Select, scope: Scope, names: list[str]):
        """[(column, direction)], and the column that breaks ties."""
        keys, scored = [], False
        for e, desc in s.order:
            if scored:
                raise QueryError("nothing can follow a score in ORDER BY")
            target = scope.aliases.get(e[1][0], e) if e[0] == "col" and len(e[1]) == 1 and (e[1][0] in scope.aliases and ((e[1][0],) not in scope.columns or scope.match)) else e
            nearest = target[0] == "op" and target[1] in vector.OPERATORS
            is_score = not nearest and (target[0] in ("neg",) or target[0] == "op" and target[1] in "+-*/" or target[0] == "call" and target[1] in SCORES)
            old, self.scoring = self.scoring, is_score
            c = self.expr(target, scope)
            self.scoring = old
            if nearest:
                scored = True
                keys.append((c, lambda x, d=bool(desc): x.desc_nulls_last() if d else x.asc_nulls_last()))
            elif is_score:
                scored = True
                down = True if desc is None else desc
                keys.append((c, lambda x, d=down: score_ordered(x, d)))
            else:
                keys.append((c, lambda x, d=bool(desc): ordered(x, d)))
        tie = None if scope.match else scope.columns.get(("_id",), (None,))[0]
        return keys, tie

    def grouped(self, s: Select, df: DataFrame, scope: Scope) -> DataFrame:
        """GROUP BY, or one group of all rows; HAVING and ORDER BY may use any aggregate."""
        keys = {}
        for g in s.group:
            if g[0] == "col" and len(g[1]) == 1 and g[1] not in scope.columns and g[1][0] in scope.aliases:
                g = scope.aliases[g[1][0]]
            keys[e_key(g)] = f"_g{len(keys)}"
        exprs = {e_key(g): g for g in [scope.aliases[g[1][0]] if g[0] == "col" and len(g[1]) == 1 and g[1] not in scope.columns and g[1][0] in scope.aliases else g for g in s.group]}
        wanted: dict[str, tuple] = {}
        order = [(scope.aliases.get(e[1][0], e) if e[0] == "col" and len(e[1]) == 1 and e_key(e) not in keys else e, d) for e, d in s.order]
        for top in [e for e, _ in s.items] + ([s.having] if s.having else []) + [e for e, _ in order]:
            for x in walk(top):
                if x[0] == "call" and x[1] in AGGREGATES:
                    wanted.setdefault(e_key(x), x)
        loose: dict[str, tuple] = {}

        def inner(e: tuple) -> tuple:
            """e over the grouped frame."""
            if e_key(e) in keys:
                return ("col", (keys[e_key(e)],))
            if e_key(e) in wanted:
                return ("col", (f"_a{list(wanted).index(e_key(e))}",))
            if e[0] == "star":
                raise QueryError("* can't be grouped")
            if e[0] == "col":
                if e[1][0] in scope.local:
                    return e
                if not self.loosely:
                    raise QueryError(f"{'.'.join(e[1])} must be grouped or aggregated")
                loose.setdefault(e_key(e), e)
                return ("col", (f"_l{list(loose).index(e_key(e))}",))
            if e[0] == "call" and e_key(e) in self.made:
                loose.setdefault(e_key(e), e)
                return ("col", (f"_l{list(loose).index(e_key(e))}",))
            return tuple(sub(x) for x in e)

        def sub(x):
            if isinstance(x, tuple) and x and isinstance(x[0], str) and x[0] in KINDS:
                return inner(x)
            if isinstance(x, tuple):
                return tuple(sub(y) for y in x)
            if isinstance(x, list):
                return [sub(y) for y in x]
            return x

        def outer(e: tuple) -> tuple:
            self.loosely = e[0] == "call" and e[1] not in AGGREGATES or e[0] in ("case", "path")  # functions take a row's value
            return inner(e)

        items = [(outer(e), a or default_name(e)) for e, a in s.items]
        having = outer(s.having) if s.having else None
        order = [(outer(e), d) for e, d in order]
        aggs = [self.expr(x, scope).alias(f"_a{i}") for i, x in enumerate(wanted.values())]
        aggs += [F.first(self.expr(x, scope), ignorenulls=False).alias(f"_l{i}") for i, x in enumerate(loose.values())]
        if keys:
            by = [self.expr(exprs[k], scope).alias(n) for k, n in keys.items()]
            got = df.groupBy(*by).agg(*aggs) if aggs else df.select(*by).distinct()
        else:
            got = df.agg(*aggs)
        kinds = dict(got.dtypes)
        flat = Scope(got, {(n,): (n, kinds[n]) for n in got.columns})
        made, self.made = self.made, {}
        if having is not None:
            got = got.filter(self.expr(having, flat))
        columns = [(self.expr(e, flat), n) for e, n in items]
        sorts = [(self.expr(e, flat), d) for e, d in order]
        out = got.select(*[c.alias(n) for c, n in columns], *[c.alias(f"_o{i}") for i, (c, _) in enumerate(sorts)])
        self.made = made
        if s.distinct:
            out = out.distinct()
        if sorts:
            out = out.orderBy(*[ordered(F.col(f"_o{i}"), bool(d)) for i, (_, d) in enumerate(sorts)], *[ordered(F.col(f"`{n}`")) for _, n in columns])
        return out.drop(*[f"_o{i}" for i in range(len(sorts))])

    loosely = False

    def rows(self, e: tuple) -> int:
        n = int(self.value(e))
        if not 0 <= n <= MAX_ROWS:
            raise QueryError(f"LIMIT and OFFSET go from 0 to {MAX_ROWS}")
        return n

    def limited(self, s: Select, df: DataFrame) -> DataFrame:
        if s.offset is not None:
            df = df.offset(self.rows(s.offset))
        if s.limit is not None:
            df = df.limit(self.rows(s.limit))
        return df


KINDS = {"lit", "param", "col", "path", "call", "op", "neg", "not", "and", "or", "in", "any", "between", "null", "like", "case", "array", "object", "point", "polygon", "star", "quant", "contains", "typo"}


NOW = ("call", "NOW", [], False)


def e_key(e: tuple) -> str:
    return repr(e)


def is_key(c: tuple) -> bool:
    return c[0] == "op" and c[1] == "=" and c[2][0] == "col" and c[2][1][-1] == "_key"


def path_fold(name: str, a: Column) -> Column:
    """A fold over an array of a row; NULL without items."""
    nums = F.filter(F.transform(a, lambda x: x.cast("double")), lambda x: x.isNotNull()) if name not in ("PATH_FIRST", "PATH_LAST") else a
    some = F.size(nums) > 0
    total = F.aggregate(nums, F.lit(0.0), lambda s, x: s + x)
    folds = {
        "PATH_SUM": lambda: total,
        "PATH_AVG": lambda: total / F.size(nums),
        "PATH_MIN": lambda: F.array_min(nums),
        "PATH_MAX": lambda: F.array_max(nums),
        "PATH_PRODUCT": lambda: F.aggregate(nums, F.lit(1.0), lambda s, x: s * x),
        "PATH_FIRST": lambda: F.get(nums, F.lit(0)),
        "PATH_LAST": lambda: F.element_at(nums, -1),
    }
    return F.when(some, folds[name]())


def default_name(e: tuple) -> str:
    match e[0]:
        case "col":
            return e[1][-1]
        case "path":
            return str(e[2][-1])
        case "case":
            return "case"
        case "call":
            if e[1] == "BM25" and e[2][0][0] == "col":
                return f"_bm25_{e[2][0][1][-1]}_score"
            return e[1].lower()
    return "expr"


def lower_query(catalog: Catalog, text: str, params: list | None = None) -> DataFrame:
    return Lowering(catalog, params).select(parse_select(text))
