"""A catalog as a folder of Parquet with a manifest, or as SQL text; both come back as they were."""

from __future__ import annotations

import json
from ast import literal_eval
from collections.abc import Iterator
from dataclasses import asdict

from pyspark.sql import functions as F

from ..catalog import Collection, ColumnDef, EdgePart
from ..engine import Engine


def dump(engine: Engine, path: str) -> None:
    """Every frame as Parquet, written by the executors; the manifest is one small text file."""
    cat = engine.catalog
    manifest = {
        "collections": {n: {"columns": [{**asdict(x), "default": repr(x.default), "generated": repr(x.generated)} for x in c.columns] if c.columns is not None else None, "body": c.body, "auto_index": c.auto_index} for n, c in cat.collections.items()},
        "edges": [[t, p.source, p.target, p.sound] for t, parts in cat.edges.items() for p in parts],
        "indexes": {n: [c, m, list(f)] for n, (c, m, f) in cat.indexes.items()},
    }
    for n, c in cat.collections.items():
        c.df.write.mode("overwrite").parquet(f"{path}/nodes/{n}")
    for i, (_, p) in enumerate((t, p) for t, parts in cat.edges.items() for p in parts):
        p.df.write.mode("overwrite").parquet(f"{path}/edges/{i}")
    engine.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def restore(engine: Engine, path: str) -> Engine:
    manifest = json.loads(engine.spark.read.text(f"{path}/manifest").first()[0])
    cat = engine.catalog
    for n, c in manifest["collections"].items():
        columns = [ColumnDef(**{**x, "default": literal_eval(x["default"]), "generated": literal_eval(x["generated"])}) for x in c["columns"]] if c["columns"] is not None else None
        cat.collections[n] = Collection(engine.spark.read.parquet(f"{path}/nodes/{n}"), columns, c["body"], c["auto_index"])
    for i, (t, a, b, sound) in enumerate(manifest["edges"]):
        cat.edges.setdefault(t, []).append(EdgePart(a, b, engine.spark.read.parquet(f"{path}/edges/{i}"), sound))
    cat.indexes |= {n: (c, m, tuple(f)) for n, (c, m, f) in manifest["indexes"].items()}
    return engine


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(literal(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def dump_sql(engine: Engine) -> Iterator[str]:
    """Statements that make the catalog again, a row at a time: for small catalogs and for reading."""
    cat = engine.catalog
    for n, c in cat.collections.items():
        if c.columns is not None:
            yield engine.schema_ddl(n)
        fields = [f for f in c.df.columns if f not in ("_created_unix", "_updated_unix") and not (c.columns and any(x.name == f and x.generated for x in c.columns))]
        for r in c.df.select(*fields).orderBy("_key").toLocalIterator():
            some = [f for f in fields if r[f] is not None]
            yield f"INSERT INTO {n} ({', '.join(some)}) VALUES ({', '.join(literal(r[f]) for f in some)})"
    for t, parts in cat.edges.items():
        for p in parts:
            attrs = [f for f in p.df.columns if f not in ("_src", "_dst")]
            for r in p.df.orderBy(*[F.col(f"`{f}`") for f in p.df.columns]).toLocalIterator():
                props = ", ".join(f"{f}: {literal(r[f])}" for f in attrs if r[f] is not None)
                yield f"INSERT ({literal(p.source + '/' + r['_src'])})-[:{t}{' {' + props + '}' if props else ''}]->({literal(p.target + '/' + r['_dst'])})"
    for n, (c, m, f) in cat.indexes.items():
        yield f"CREATE INDEX {n} ON {c} USING {m} ({', '.join(f)})"


def load_sql(engine: Engine, statements: Iterator[str]) -> int:
    return sum(engine.execute(s) for s in statements if s.strip())
