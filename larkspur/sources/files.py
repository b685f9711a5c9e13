"""Collections and edges from files, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import QueryError

FORMATS = {"parquet": {}, "json": {}, "ndjson": {}, "csv": {"header": "true"}, "orc": {}}


def read(engine: Engine, path: str, form: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Give a schema for text formats: without one, Spark reads the files twice to guess it."""
    if form not in FORMATS:
        raise QueryError(f"no format {form}")
    reader = engine.spark.read.options(**{**FORMATS[form], **options})
    if schema:
        reader = reader.schema(schema)
    elif form == "csv":
        reader = reader.option("inferSchema", "true")
    return reader.format("json" if form == "ndjson" else form).load(path)


def load_collection(engine: Engine, name: str, path: str, key: str = "_key", form: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    df = read(engine, path, form, schema, **options)
    engine.register(name, df, None if key == "_key" else key)
    return df


def load_edges(engine: Engine, kind: str, source: str, target: str, path: str, src: str, dst: str, form: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    df = read(engine, path, form, schema, **options)
    engine.register_edges(kind, source, target, df, src, dst)
    return df


def save(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None, **options: str) -> None:
    """A result as files; `by` partitions them, with one writer per value so that there aren't many small ones."""
    out = df.repartition(*[F.col(f"`{c}`") for c in by]) if by else df
    writer = out.write.options(**{**FORMATS[form], **options}).format("json" if form == "ndjson" else form).mode("overwrite")
    (writer.partitionBy(*by) if by else writer).save(path)
