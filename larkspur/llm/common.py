"""What the training-data operators share: loading, shared scratch tables, samples and row keys."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder, written  # noqa: F401
from ..session import ready  # noqa: F401


def load(spark: SparkSession, sf_dir: str, table: str, spread: bool = False) -> DataFrame:
    """A table; spread deals the rows of one that lies in fewer pieces than there are cores, for work in Python.

    A table of many files is left as it lies: then nothing is moved.
    """
    df = ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        df = df.repartition(4 * cores, F.xxhash64("doc_id", F.length("text")))
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir)."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def bounded_sample(df: DataFrame, key: Column, rows: int, seed: int = 17) -> DataFrame:
    """At most about `rows` rows, those with the smallest hashes of key: the same rows on every run and layout.

    Two light passes: one counts, the other filters by hash, so nothing is sorted or sent but the sample. For
    fitting models only.
    """
    total = df.count()
    if total <= rows:
        return df
    top = int(rows / total * 2**32)
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2**32)) < top)


def text_key(text: Column | str) -> Column:
    """With doc_id it tells rows apart: 128 bits of the text, and no bits for NULL."""
    return F.coalesce(F.unhex(F.md5(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))), F.lit(b""))


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    return to_arrow_schema(kind)


def map_arrow(df: DataFrame, fn, schema: str, rows: int = 2048) -> DataFrame:
    """mapInArrow for a function from a pyarrow RecordBatch of up to `rows` to a dict of columns (or None for no rows)."""
    ready(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                out = fn(batch.slice(lo, rows))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type) for f, x in ((f, out[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per row from the lists' items end to end."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): all output bits depend on all input bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_CODEC = pa.Codec("zstd")


def squeezed(x: np.ndarray) -> bytes:
    """An array of integers, its bytes sorted by their place and compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def opened(cell: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(cell[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(cell[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


SPARE_BITS = 24


def key_bits(things: int) -> int:
    """Bits of a hash so that another of so many things has a thing's hash with a chance of 2**-SPARE_BITS."""
    return min(64, max(1, things).bit_length() + SPARE_BITS)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Within, Arrow batches end at `size`: for rows of megabytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def written_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a table in the shared folder, in buckets of key: joined by key it stays where it is."""
    spark = df.sparkSession
    path, table = scratch(spark, name), f"larkspur_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).format("parquet").saveAsTable(table)
    return spark.table(table)


def joined_by(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """df, from written_by, with the columns of more by key where it has any."""
    return df.join(more.hint("shuffle_merge"), key, "left")
