"""Lowering MATCH: patterns become joins of node and edge frames, bounded walks unions of joins, others loops.

A variable's columns carry its name; only the fields that the statement uses are carried, and conditions apply as
soon as their variables are bound. A label holds wherever it stands. When all that is asked is COUNT(*) or a set,
walks are merged per node after every hop instead of being listed (modes `count` and `set`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import slug
from ..errors import QueryError
from ..operators import graph
from ..scratch import written
from .lower import AGGREGATES, Lowering, Scope, default_name
from .parser import Hop, Node, Pattern, Select, conjuncts, walk

BUILT_IN = ("_id", "_key", "_collection")
REL = "struct<from:string,to:string,type:string,attrs:string>"


def col_name(var: str, field: str) -> str:
    return f"{var}·{field}"


def lower(lw: Lowering, s: Select) -> DataFrame:
    if any(src.pattern and src.pattern.shortest for src in s.sources):
        return _shortest(lw, s)
    if s.graph:
        return _graph(lw, s)
    if s.union:
        first, second = _rows(lw, s), lower(Lowering(lw.catalog, lw.params), s.union)
        if first.columns != second.columns:
            first = first.unionByName(second, allowMissingColumns=True) if set(first.columns) ^ set(second.columns) else first.unionByName(second)
            return first.distinct()
        return first.union(second).distinct()
    return _rows(lw, s)


def variables(patterns: list[Pattern]) -> set[str]:
    return {n.var for p in patterns for n in p.nodes} | {h.var for p in patterns for h in p.hops if h.var} | {p.path for p in patterns if p.path}


class Needs:
    """Which fields of which variables the statement uses; '*' for all."""

    def __init__(self, exprs: list[tuple], known: set[str]):
        self.fields: dict[str, set[str]] = {}
        for e in exprs:
            for x in walk(e):
                if x[0] == "col" and x[1][0] in known:
                    self.fields.setdefault(x[1][0], set()).add(x[1][1] if len(x[1]) > 1 else "*")
                elif x[0] == "star" and x[1] in known:
                    self.fields.setdefault(x[1], set()).add("*")
                elif x[0] == "star" and x[1] is None and e[0] == "star":
                    for v in known:
                        self.fields.setdefault(v, set()).add("*")
                elif x[0] == "call" and x[1] in ("SEARCH", "SEARCH_SCORE"):
                    for v in known:
                        self.fields.setdefault(v, set()).add("*")

    def of(self, var: str) -> set[str]:
        return self.fields.get(var, set())


class Match:
    """A match as it is built: the frame, the scope, and the conditions that still wait for variables."""

    def __init__(self, lw: Lowering, needs: Needs, conds: list[tuple], known: set[str], mode: str = "rows"):
        self.lw, self.needs, self.waiting, self.known, self.mode = lw, needs, conds, known, mode
        self.df: DataFrame | None = None
        self.scope = Scope(None, {}, match=True)
        self.bound: dict[str, str] = {}  # node variable -> column of its identity
        self.plain: dict[str, bool] = {}  # whether that is the key alone, as all are of one collection, or the slug
        self.labels: dict[str, set[str] | None] = {}

    # nodes
    def node_columns(self, n: Node, labels: set[str]) -> tuple[list[str], dict[str, str]]:
        """The fields to load for a node, and their types."""
        wanted = self.needs.of(n.var) | set(n.props) | ({x[1][-1] for x in walk(n.where or ()) if x[0] == "col" and (len(x[1]) == 1 or x[1][0] == n.var)} if n.where else set())
        kinds = {}
        for label in labels:
            for c, k in self.lw.catalog.nodes(label).dtypes:
                kinds.setdefault(c, k)
        fields = [c for c in kinds if "*" in wanted or c in wanted]
        unknown = wanted - set(kinds) - {"*"}
        for f in unknown:  # absent fields are NULL
            kinds[f] = "string"
        return fields + sorted(unknown), kinds

    def node_frame(self, n: Node, labels: set[str], plain: bool) -> tuple[DataFrame, list[tuple[str, str]]]:
        fields, kinds = self.node_columns(n, labels)
        df = self.lw.catalog.nodes(next(iter(labels))) if len(labels) == 1 else self.lw.catalog.every(sorted(labels))
        if len(labels) == 1:
            df = self.lw.keyed(df, next(iter(labels)), [c for c in self.waiting if c[0] == "op" and c[2] == ("col", (n.var, "_key"))])
        have = set(df.columns)
        picked = [F.col(f"`{f}`") if f in have else F.lit(None).cast("string") for f in fields]
        whole = "*" in self.needs.of(n.var) and any(x[0] == "col" and x[1] == (n.var,) for x in self.exprs())
        out = df.select(F.col("_key" if plain else "_id").alias(col_name(n.var, "@")), *[c.alias(col_name(n.var, f)) for c, f in zip(picked, fields)], *([F.struct(*[c for c in df.columns]).alias(col_name(n.var, "node"))] if whole else []))
        if whole:
            self.scope.nodes[n.var] = col_name(n.var, "node")
        return out, [(f, kinds[f]) for f in fields]

    all_exprs: list[tuple] = []

    def exprs(self):
        return (x for e in self.all_exprs for x in walk(e))

    def bind(self, n: Node, columns: list[tuple[str, str]], labels: set[str], plain: bool) -> None:
        self.bound[n.var], self.plain[n.var] = col_name(n.var, "@"), plain
        for f, k in columns:
            self.scope.columns[(n.var, f)] = (col_name(n.var, f), k)
        if len(labels) == 1:
            label = next(iter(labels))
            self.scope.corpora[n.var] = (label, self.lw.catalog.collection(label).df)

    def inline(self, n: Node) -> None:
        """{k: v} and WHERE within a node."""
        for k, v in n.props.items():
            self.df = self.df.filter(F.col(f"`{col_name(n.var, k)}`") == F.lit(self.lw.value(v)))
        if n.where:
            self.waiting.append(_qualified(n.where, n.var, {c[1] for c in self.scope.columns if c[0] == n.var}, self.scope))

    def settle(self) -> None:
        """Apply the conditions whose variables are all bound."""
        self.scope.frame = self.df
        have = {p[0] for p in self.scope.columns} | set(self.scope.nodes)
        now = [c for c in self.waiting if {x[1][0] for x in walk(c) if x[0] == "col" and x[1][0] in self.known} <= have]
        self.waiting = [c for c in self.waiting if c not in now]
        if now:
            self.df = self.lw.apply(self.df, self.scope, now)
            self.scope.frame = self.df

    def start(self, p: Pattern) -> None:
        n = p.nodes[0]
        if n.var in self.bound:
            return
        labels = {n.label.removeprefix("public.")} if n.label else None
        if labels is None:
            if p.hops:
                parts = self.lw.catalog.parts(p.hops[0].types)
                out = {q.source for _, q in parts} if p.hops[0].direction == "out" else {q.target for _, q in parts} if p.hops[0].direction == "in" else {x for _, q in parts for x in (q.source, q.target)}
                labels = {c for c in out if c in self.lw.catalog.collections}
            labels = labels or set(self.lw.catalog.collections)
        for label in labels:
            self.lw.catalog.collection(label)
        plain = len(labels) == 1 and not self.paths
        frame, columns = self.node_frame(n, labels, plain)
        if self.df is None:
            self.df = frame
            if self.mode == "count":
                self.df = self.df.withColumn("_w", F.lit(1).cast("bigint"))
        else:
            self.df = self.df.crossJoin(frame)
        self.bind(n, columns, labels, plain)
        self.labels[n.var] = labels
        self.inline(n)
        self.settle()

    # hops
    def slugged(self, var: str) -> Column:
        c = F.col(f"`{self.bound[var]}`")
        return slug(next(iter(self.labels[var])), c) if self.plain[var] else c

    def edge_frame(self, h: Hop, source: set[str] | None, target: set[str] | None, plain: bool, to_plain: bool | None) -> tuple[DataFrame | None, set[str], bool, bool]:
        """(src, dst, attributes) as walked, the collections of dst, whether dst is sure to exist, and is a plain key.

        plain: src is the key alone; to_plain says so of dst, None lets one collection decide.
        """
        wanted = self.needs.of(h.var) if h.var else set()
        frames, ends, sound = [], set(), True
        ways = [h.direction] if h.direction != "both" else ["out", "in"]
        kinds: dict[str, str] = {}
        found = [(way, t, part) for way in ways for t, part in self.lw.catalog.parts(h.types, *((source, target) if way == "out" else (target, source)))]
        far = {part.target if way == "out" else part.source for way, _, part in found}
        if to_plain is None:
            to_plain = len(far) == 1 and far <= set(self.lw.catalog.collections)
        for way, t, part in found:
            near_end, far_end = (("_src", part.source), ("_dst", part.target)) if way == "out" else (("_dst", part.target), ("_src", part.source))
            s = F.col(near_end[0]) if plain else slug(near_end[1], F.col(near_end[0]))
            d = F.col(far_end[0]) if to_plain else slug(far_end[1], F.col(far_end[0]))
            attrs = [c for c in part.df.columns if c not in ("_src", "_dst")]
            for k, v in h.props.items():
                if k not in attrs:
                    break
            else:
                df = part.df
                for k, v in h.props.items():
                    df = df.filter(F.col(f"`{k}`") == F.lit(self.lw.value(v)))
                use = [c for c in attrs if "*" in wanted or c in wanted]
                for c, k in part.df.dtypes:
                    if c in use:
                        kinds.setdefault(c, k)
                bag = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in attrs])) if attrs else F.lit("{}")] if self.paths else []
                frames.append(df.select(s.alias("src"), d.alias("dst"), *[F.col(f"`{c}`").alias(f"e·{c}") for c in use], *([F.lit(t).alias("_type")] if self.paths or "_type" in wanted else []), *[b.alias("_attrs") for b in bag], *([F.lit(way == "out").alias("_forward")] if self.paths else [])))
                ends.add(part.target if way == "out" else part.source)
                sound = sound and part.sound
        if not frames:
            return None, set(), True, bool(to_plain)
        self.edge_kinds = kinds
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames), ends, sound, to_plain

    edge_kinds: dict[str, str] = {}
    paths = False

    def step(self, p: Pattern, i: int) -> None:
        h, to, at = p.hops[i], p.nodes[i + 1], self.bound[p.nodes[i].var]
        labels = {to.label.removeprefix("public.")} if to.label else self.labels.get(to.var)
        if to.label:
            self.lw.catalog.collection(to.label)
        source = self.labels.get(p.nodes[i].var)
        ranged = h.ranged and (h.lo, h.hi) != (1, 1)
        near = p.nodes[i].var
        to_plain = self.plain[to.var] if to.var in self.bound else False if ranged or self.paths else None
        if ranged and to_plain:  # walks go by slugs, as they may lead through several collections
            self.df = self.df.withColumn(self.bound[to.var], self.slugged(to.var))
            self.plain[to.var] = to_plain = False
        edges, ends, sound, to_plain = self.edge_frame(h, None if ranged else source, None if ranged else labels, self.plain[near] and not ranged, to_plain)
        if edges is None:  # no such edges: no rows, but the right columns
            edges = self.lw.spark.createDataFrame([], "src string, dst string" + (", _type string, _attrs string, _forward boolean" if self.paths else ""))
            ends = labels or {next(iter(self.lw.catalog.collections))}
        if ranged:
            moved = self.walks(edges, h, near)
            ends = ends | (source or set()) if h.lo == 0 else ends
        else:
            moved = self.df.join(edges.withColumnRenamed("src", at), at).withColumnRenamed("dst", "_at")
            moved = self.remember(moved, F.col(f"`{at}`"))
            if h.var:
                self.edge_columns(h, moved)
                moved = moved.withColumnsRenamed({c: col_name(h.var, c[2:]) for c in moved.columns if c.startswith("e·")})
                if "_type" in moved.columns and "_type" in self.needs.of(h.var):
                    moved = moved.withColumnRenamed("_type", col_name(h.var, "_type"))
            moved = moved.drop("_type", "_attrs", "_forward", *[c for c in moved.columns if c.startswith("e·")])
        self.df = moved
        if to.var in self.bound:  # the walk comes back to a bound variable
            self.df = self.df.filter(F.col("_at") == F.col(f"`{self.bound[to.var]}`")).drop("_at")
            return
        ends = {c for c in ends if c in self.lw.catalog.collections and (labels is None or c in labels)}
        if not ends:
            ends = labels or set(self.lw.catalog.collections)
        self.labels[to.var] = ends
        fields, kinds = self.node_columns(to, ends)
        if sound and not ranged and set(fields) <= set(BUILT_IN):  # the identity says it all
            cut, at_ = F.instr("_at", "/"), F.col("_at")
            if to_plain:
                made = {"_id": slug(next(iter(ends)), at_), "_key": at_, "_collection": F.lit(next(iter(ends)))}
            else:
                made = {"_id": at_, "_key": F.substring(at_, cut + 1, F.char_length("_at")), "_collection": F.substring(at_, F.lit(1), cut - 1)}
            self.df = self.df.withColumns({col_name(to.var, f): made[f] for f in fields}).withColumnRenamed("_at", col_name(to.var, "@"))
            self.bind(to, [(f, "string") for f in fields], ends, to_plain)
        else:
            frame, columns = self.node_frame(to, ends, to_plain)
            self.df = self.df.withColumnRenamed("_at", col_name(to.var, "@")).join(frame, col_name(to.var, "@"))
            self.bind(to, columns, ends, to_plain)
        self.inline(to)
        self.settle()

    def edge_columns(self, h: Hop, df: DataFrame) -> None:
        for c, k in self.edge_kinds.items():
            self.scope.columns[(h.var, c)] = (col_name(h.var, c), k)
        for f in self.needs.of(h.var) - {"*"} - set(self.edge_kinds) - {"_type"}:
            self.absent.append((h.var, f))
        if "_type" in self.needs.of(h.var):
            self.scope.columns[(h.var, "_type")] = (col_name(h.var, "_type"), "string")

    absent: list[tuple[str, str]] = []

    def remember(self, df: DataFrame, came: Column) -> DataFrame:
        """Add a hop to the path columns."""
        if not self.paths:
            return df
        rel = F.struct(F.when(F.col("_forward"), came).otherwise(F.col("_at")).alias("from"), F.when(F.col("_forward"), F.col("_at")).otherwise(came).alias("to"), F.col("_type").alias("type"), F.col("_attrs").alias("attrs"))
        return df.withColumns({"_nodes": F.concat("_nodes", F.array("_at")), "_rels": F.concat("_rels", F.array(rel.cast(REL)))})

    def walks(self, edges: DataFrame, h: Hop, start: str) -> DataFrame:
        """The frame moved along lo to hi edges: a row per walk, or merged as the mode allows."""
        along = {c: k for c, k in self.edge_kinds.items()} if h.var and self.mode == "rows" else {}
        slim = edges.drop(*[c for c in edges.columns if c.startswith("e·") and c[2:] not in along])
        frontier = self.df.withColumn("_at", self.slugged(start))
        for c, k in along.items():  # an edge variable of many hops has an array of each attribute, in walking order
            frontier = frontier.withColumn(col_name(h.var, c), F.array().cast(f"array<{k}>"))
            self.scope.columns[(h.var, c)] = (col_name(h.var, c), f"array<{k}>")
        both = h.direction == "both"
        if self.mode != "rows":  # merging needs no columns but those still to be used
            used = {self.scope.columns[(v, f)][0] for v, f in self.scope.columns if f in self.needs.of(v) or "*" in self.needs.of(v)} | {c for v in self.later for c in [self.bound.get(v)] if c}
            frontier = frontier.select(*[f"`{c}`" for c in frontier.columns if c in used or c in ("_at", "_w")])
            self.scope.columns = {k: v for k, v in self.scope.columns.items() if v[0] in used}
            self.bound = {v: c for v, c in self.bound.items() if c in used}
            frontier = self.merged(frontier)
        if both:
            frontier = frontier.withColumn("_came", F.lit(None).cast("string"))
        out = [frontier] if h.lo == 0 else []
        for level in range(1, h.hi + 1):
            here = frontier.withColumnRenamed("_at", "_from")
            step = here.join(slim.withColumnsRenamed({"src": "_from", "dst": "_at"}), "_from")
            if both:
                step = step.filter(~F.col("_at").eqNullSafe(F.col("_came"))).withColumn("_came", F.col("_from"))
            step = step.withColumns({col_name(h.var, c): F.array_append(F.col(f"`{col_name(h.var, c)}`"), F.col(f"`e·{c}`")) for c in along}) if along else step
            step = self.remember(step, F.col("_from")).drop("_from", "_type", "_attrs", "_forward", *[f"e·{c}" for c in along])
            frontier = self.merged(step).select(frontier.columns)
            if h.hi > graph.LAZY_LEVELS:
                frontier = written(frontier, "walks")
                if frontier.isEmpty():
                    break
            if level >= h.lo:
                out.append(frontier)
        found = reduce(lambda a, b: a.unionByName(b), out) if out else frontier.limit(0)
        return self.merged(found.drop("_came")) if self.mode != "rows" else found.drop("_came")

    later: set[str] = set()

    def merged(self, df: DataFrame) -> DataFrame:
        if self.mode == "count":
            return df.groupBy(*[f"`{c}`" for c in df.columns if c != "_w"]).agg(F.sum("_w").alias("_w"))
        return df.distinct() if self.mode == "set" else df

    def pattern(self, p: Pattern) -> None:
        if p.path and self.mode == "rows":
            self.paths = True
        self.start(p)
        if self.paths:
            for var in {n.var for n in p.nodes} & set(self.bound):  # paths are of slugs
                self.df = self.df.withColumn(self.bound[var], self.slugged(var))
                self.plain[var] = False
            self.df = self.df.withColumns({"_nodes": F.array(F.col(f"`{self.bound[p.nodes[0].var]}`")), "_rels": F.array().cast(f"array<{REL}>")})
        for i in range(len(p.hops)):
            self.later = {n.var for n in p.nodes[i + 1 :]} | self.shared
            self.step(p, i)
        if self.paths:
            self.df = self.df.withColumnsRenamed({"_nodes": col_name(p.path, "nodes"), "_rels": col_name(p.path, "rels")})
            self.scope.columns[(p.path, "nodes")] = (col_name(p.path, "nodes"), "array<string>")
            self.scope.columns[(p.path, "rels")] = (col_name(p.path, "rels"), f"array<{REL}>")
            self.paths = False
        self.settle()

    shared: set[str] = set()

    def fill_absent(self) -> None:
        for var, f in self.absent:
            if (var, f) not in self.scope.columns:
                self.df = self.df.withColumn(col_name(var, f), F.lit(None).cast("string"))
                self.scope.columns[(var, f)] = (col_name(var, f), "string")


def _qualified(e, var: str, fields: set[str], scope: Scope):
    """A condition within a node: bare names are the node's fields, others aliases of an earlier WITH."""
    if isinstance(e, tuple) and e and e[0] == "col":
        return ("col", (var, e[1][0])) if len(e[1]) == 1 and e[1][0] in fields and (e[1][0],) not in scope.columns else e
    if isinstance(e, tuple):
        return tuple(_qualified(x, var, fields, scope) for x in e)
    return [_qualified(x, var, fields, scope) for x in e] if isinstance(e, list) else e


def _path_checks(exprs: list[tuple], paths: set[str]) -> None:
    for e in exprs:
        for x in walk(e):
            if x[0] == "col" and x[1][0] in paths and len(x[1]) > 1:
                raise QueryError(f"{x[1][0]} is a path: use length(), nodes() or relationships()")


def _mode(s: Select, patterns: list[Pattern]) -> str:
    """Whether walks may be merged: only counts are asked, or only sets."""
    if s.stages or any(p.path for p in patterns) or not any(h.ranged for p in patterns for h in p.hops):
        return "rows"
    edge_vars = {h.var for p in patterns for h in p.hops if h.var}
    exprs = [e for e, _ in s.items] + [e for e, _ in s.order] + ([s.having] if s.having else [])
    calls = [x for e in exprs for x in walk(e) if x[0] == "call"]
    if any(x[0] == "col" and x[1][0] in edge_vars for e in exprs + s.group + ([s.where] if s.where else []) for x in walk(e)):
        return "rows"
    if any(x[0] == "star" for e, _ in s.items for x in [e]):
        return "set" if s.distinct and not any(c[1] in AGGREGATES for c in calls) else "rows"
    aggs = [c for c in calls if c[1] in AGGREGATES]
    if aggs and all(c[1] == "COUNT" and not c[3] for c in aggs):
        return "count"
    if aggs and all(c[1] in ("COUNT", "MIN", "MAX") and (c[3] or c[1] != "COUNT") for c in aggs):
        return "set"
    return "set" if s.distinct and not aggs else "rows"


def _rows(lw: Lowering, s: Select) -> DataFrame:
    patterns = [src.pattern for src in s.sources if src.pattern]
    known = variables(patterns) | {src.alias or src.name for src in s.sources if not src.pattern}
    later = variables([p for st in s.stages for p in st.patterns])
    exprs = [e for e, _ in s.items] + s.group + [e for e, _ in s.order] + [x for x in (s.having, s.where) if x] + [st.where for st in s.stages if st.where] + [e for st in s.stages for e, _ in st.items]
    exprs += [n.where for p in patterns for n in p.nodes if n.where] + [n.where for st in s.stages for p in st.patterns for n in p.nodes if n.where]
    paths = {p.path for p in patterns if p.path}
    _path_checks(exprs, paths)
    mode = _mode(s, patterns) if len(s.sources) == 1 else "rows"
    counting = mode != "rows"
    # in the merged modes, what only WHERE uses isn't carried on
    needs = Needs(exprs, known | later)
    m = Match(lw, needs, conjuncts(s.where), known | later, mode)
    m.all_exprs = exprs
    if counting:
        m.shared = {x[1][0] for c in m.waiting for x in walk(c) if x[0] == "col"}
        m.shared = {v for v in m.shared if v in known}
    for src in s.sources:
        if src.pattern:
            m.pattern(src.pattern)
        else:
            name = src.alias or src.name
            df = lw.catalog.nodes(src.name)
            df = df.select(*[F.col(f"`{c}`").alias(col_name(name, c)) for c in df.columns])
            for c, k in lw.catalog.nodes(src.name).dtypes:
                m.scope.columns[(name, c)] = (col_name(name, c), k)
            m.scope.corpora[name] = (src.name, lw.catalog.collection(src.name).df)
            m.df = df if m.df is None else m.df.crossJoin(df)
            m.settle()
    m.fill_absent()
    m.settle()
    for stage in s.stages:
        _stage(lw, m, stage)
    if m.waiting:
        bad = next(x[1] for c in m.waiting for x in walk(c) if x[0] == "col")
        raise QueryError(f"no variable {'.'.join(bad)}")
    m.scope.frame = m.df
    _outer_names(m.scope)
    return lw.finish(s, m.df, m.scope)


def _outer_names(scope: Scope) -> None:
    """A bare variable that isn't a node stands for an alias; bare fields work if only one variable has them."""
    bare: dict[str, list] = {}
    for parts, c in scope.columns.items():
        if len(parts) == 2:
            bare.setdefault(parts[1], []).append(c)
    for f, cs in bare.items():
        if len(cs) == 1 and (f,) not in scope.columns:
            scope.columns[(f,)] = cs[0]


def _stage(lw: Lowering, m: Match, stage) -> None:
    """WITH: outputs without an aggregate are the group's keys; nodes stay bound under their new names."""
    has_agg = any(x[0] == "call" and x[1] in AGGREGATES for e, _ in stage.items for x in walk(e))
    m.scope.frame = m.df
    keep, aggs = [], []
    columns, bound, labels, corpora, nodes, plain = (dict() for _ in range(6))
    for e, alias in stage.items:
        if e[0] == "col" and len(e[1]) == 1 and e[1][0] in m.bound:  # a node
            old, new = e[1][0], alias or e[1][0]
            for parts, (c, k) in list(m.scope.columns.items()):
                if parts[0] == old:
                    keep.append((F.col(f"`{c}`"), col_name(new, parts[1])))
                    columns[(new, parts[1])] = (col_name(new, parts[1]), k)
            keep.append((F.col(f"`{m.bound[old]}`"), col_name(new, "@")))
            bound[new], labels[new], plain[new] = col_name(new, "@"), m.labels.get(old), m.plain[old]
            if old in m.scope.corpora:
                corpora[new] = m.scope.corpora[old]
            if old in m.scope.nodes:
                keep.append((F.col(f"`{m.scope.nodes[old]}`"), col_name(new, "node")))
                nodes[new] = col_name(new, "node")
        else:
            name = alias or default_name(e)
            is_agg = any(x[0] == "call" and x[1] in AGGREGATES for x in walk(e))
            old, lw.scoring = lw.scoring, True
            (aggs if is_agg else keep).append((lw.expr(e, m.scope), name))
            lw.scoring = old
            columns[(name,)] = (name, "double" if is_agg else "string")
    if has_agg:
        m.df = m.df.groupBy(*[c.alias(n) for c, n in keep]).agg(*[c.alias(n) for c, n in aggs])
    else:
        m.df = m.df.select(*[c.alias(n) for c, n in keep])
    kinds = dict(m.df.dtypes)
    m.scope.columns = {p: (c, kinds[c]) for p, (c, _) in columns.items()}
    m.plain = plain
    m.bound, m.labels, m.scope.corpora, m.scope.nodes, m.scope.frame = bound, labels, corpora, nodes, m.df
    m.known |= {n for (n, *rest) in columns}
    m.waiting = m.waiting + conjuncts(stage.where)
    m.settle()
    for p in stage.patterns:
        m.pattern(p)
    m.fill_absent()
    m.settle()


def _graph(lw: Lowering, s: Select) -> DataFrame:
    """SELECT GRAPH: one row with the nodes and edges of all matching walks, each once; LIMIT caps the starts."""
    p = s.sources[0].pattern
    p.path = p.path or "_path"
    exprs = ([s.where] if s.where else []) + [n.where for n in p.nodes if n.where]
    m = Match(lw, Needs(exprs, variables([p])), conjuncts(s.where), variables([p]))
    m.all_exprs = exprs
    m.paths = True
    m.start(p)
    if s.limit is not None:
        m.df = m.df.orderBy(f"`{m.bound[p.nodes[0].var]}`").limit(int(lw.value(s.limit)))
    m.pattern(p)
    slugs = m.df.select(F.explode(f"`{col_name(p.path, 'nodes')}`").alias("_id")).distinct()
    ends = {c for h in p.hops for _, q in lw.catalog.parts(h.types) for c in (q.source, q.target)} | m.labels[p.nodes[0].var]
    every = lw.catalog.every(sorted(ends & set(lw.catalog.collections)))
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in every.columns if c not in ("_id", "_collection")]))
    nodes = every.join(slugs, "_id", "left_semi").select(F.struct(F.col("_id").alias("slug"), F.col("_collection").alias("collection"), F.col("_key").alias("key"), payload.alias("payload")).alias("n"))
    edges = m.df.select(F.explode(f"`{col_name(p.path, 'rels')}`").alias("e")).distinct()
    a = nodes.agg(F.array_sort(F.collect_list("n")).alias("nodes"))
    return a.crossJoin(edges.agg(F.array_sort(F.collect_list("e")).alias("edges")))


def _shortest(lw: Lowering, s: Select) -> DataFrame:
    """MATCH SHORTEST (a)-[r*]->(b) with both keys given: no row, or the one shortest path over all edge types."""
    p = s.sources[0].pattern
    if len(p.hops) != 1 or len(s.sources) > 1:
        raise QueryError("SHORTEST takes one pattern of one hop")
    h = p.hops[0]
    if h.types or h.props or (h.lo, h.hi) != (1, 1) or h.direction != "out":
        raise QueryError("a shortest path has no type, bound or other direction: (a)-[r*]->(b)")
    a, b, r = p.nodes[0], p.nodes[1], h.var or p.path or "_r"
    ends, rest = {}, []
    for c in conjuncts(s.where):
        if c[0] == "op" and c[1] == "=" and c[2][0] == "col" and c[2][1][-1] == "_key" and c[2][1][0] in (a.var, b.var):
            ends[c[2][1][0]] = str(lw.value(c[3]))
        else:
            rest.append(c)
    if set(ends) != {a.var, b.var}:
        raise QueryError("SHORTEST needs the _key of both ends")
    cat = lw.catalog
    full = {n.var: f"{n.label}/{ends[n.var]}" if n.label and "/" not in ends[n.var] else ends[n.var] for n in (a, b)}
    frames = [part.df.select(slug(part.source, F.col("_src")).alias("src"), slug(part.target, F.col("_dst")).alias("dst"), F.lit(t).alias("type")) for t, part in cat.between(full[a.var].split("/")[0], full[b.var].split("/")[0])]
    spark = lw.spark
    edges = reduce(lambda x, y: x.unionByName(y), frames) if frames else spark.createDataFrame([], "src string, dst string, type string")
    ends_in = sorted({v.split("/")[0] for v in full.values()} & set(cat.collections))
    every = cat.every(ends_in) if ends_in else cat.every()
    have = every.filter(F.col("_id").isin(*full.values()))
    if have.select("_id").distinct().count() < len(set(full.values())):
        path = spark.createDataFrame([], "length int, nodes array<string>, types array<string>")
    else:
        path = graph.shortest_path(edges, full[a.var], full[b.var])
    between = F.zip_with(F.zip_with(F.slice("nodes", F.lit(1), F.size("types")), F.slice("nodes", F.lit(2), F.size("types")), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), "types", lambda e, t: F.struct(e.x.alias("from"), e.y.alias("to"), t.alias("type"), F.lit("{}").alias("attrs")))
    df = path.select(F.col("nodes").alias(col_name(r, "nodes")), between.alias(col_name(r, "rels")))
    quants = [x for c in rest for x in walk(c) if x[0] == "quant"]
    fields = {x[1][-1] for q in quants for x in walk(q[4]) if x[0] == "col" and x[1][0] == q[2]}
    if quants:  # the path's nodes with the fields that the conditions read
        on_path = df.select(F.posexplode(f"`{col_name(r, 'nodes')}`").alias("_i", "_id"))
        whole = cat.every()
        rows = on_path.join(whole, "_id").select("_i", F.struct("_id", *[F.col(f"`{f}`") if f in whole.columns else F.lit(None).cast("string").alias(f) for f in sorted(fields - {"_id"})]).alias("_n"))
        rows = rows.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_n"))), lambda x: x["_n"]).alias("_full"))
        df = df.crossJoin(rows)
    scope = Scope(df, {(r, "nodes"): (col_name(r, "nodes"), "array<string>"), (r, "rels"): (col_name(r, "rels"), "array")}, match=True)
    for n in (a, b):
        side = every.filter(F.col("_id") == full[n.var]).limit(1)
        df = df.crossJoin(side.select(*[F.col(f"`{c}`").alias(col_name(n.var, c)) for c in side.columns]))
        for c, k in side.dtypes:
            scope.columns[(n.var, c)] = (col_name(n.var, c), k)
    scope.frame = df
    for c in rest:
        df = df.filter(lw.expr(_on_full(c), Scope(df, {**scope.columns, ("_full",): ("_full", "array")}, match=True)))
    scope.frame = df
    return lw.finish(s, df, scope)


def _on_full(e):
    """nodes(r) within a quantifier stands for whole nodes."""
    if isinstance(e, tuple) and e and e[0] == "quant":
        return ("quant", e[1], e[2], ("col", ("_full",)), e[4])
    if isinstance(e, tuple):
        return tuple(_on_full(x) for x in e)
    return [_on_full(x) for x in e] if isinstance(e, list) else e


