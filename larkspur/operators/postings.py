"""A stored inverted index: postings by term, for BM25 and search, built once and read by the terms of a query.

It is made of segments: each task writes the postings of some rows after those of others, every time sorted by term, so
nothing is moved between tasks, and no task holds more than CHUNK tokens. A condition on terms is pushed to the scan,
which skips the pages of other terms. An index belongs to the frame that it was built from: another frame has none of it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import folder
from ..session import ready

#: Tokens that a task sorts at a time, and rows that it sends to the JVM at a time.
CHUNK, SENT = 4_000_000, 50_000
#: Terms within the edits of an unknown one that are named in the query; more are joined.
NAMED = 500
_BUILT: dict[tuple, Postings | None] = {}


@dataclass
class Postings:
    table: DataFrame  # term, key, tf, dl: sorted by term within segments, one row a term and key
    terms: DataFrame  # term, df
    rows: int
    mean: float

    def known(self, terms: list[str]) -> dict[str, int]:
        """How many rows have each of the terms, without those that none has."""
        return {r["term"]: r["df"] for r in self.terms.filter(F.col("term").isin(terms)).collect()}

    def bm25(self, terms: list[str]) -> DataFrame:
        """(key, score) of the rows that have a term; parts are added in the order of the terms."""
        known = self.known(terms)
        own = [t for t in terms if t in known]
        part = lambda t: T.bm25_part(F.col("tf").cast("double"), F.col("dl").cast("double"), F.lit(self.mean), T.idf(F.lit(float(self.rows)), F.lit(known[t])))
        found = self.table.filter(F.col("term").isin(own))
        if len(own) < 2:
            return found.select("key", (part(own[0]) if own else F.lit(0.0)).alias("score"))
        each = found.groupBy("key").agg(*[F.max(F.when(F.col("term") == t, part(t))).alias(f"p{i}") for i, t in enumerate(own)])
        parts = [F.coalesce(F.col(f"p{i}"), F.lit(0.0)) for i in range(len(own))]
        return each.select("key", sum(parts[1:], parts[0]).alias("score"))

    def matching(self, terms: list[str], edits: list[int]) -> DataFrame:
        """(key) of the rows that have every term; one that no row has counts within its edits."""
        known = self.known(terms)
        meant = [[t] if t in known else [] for t in terms]
        like = [F.when(T.within(F.col("term"), t, d), F.lit(i)) for i, (t, d) in enumerate(zip(terms, edits)) if d and t not in known]
        if like:
            near = self.terms.select("term", F.explode(F.array_compact(F.array(*like))).alias("asked"))
            some = near.limit(NAMED + 1).collect()
            if len(some) > NAMED:
                exact = self.terms.filter(F.col("term").isin(list(known))).select("term", F.get(F.array_compact(F.array(*[F.when(F.col("term") == t, F.lit(i)) for i, t in enumerate(terms)])), F.lit(0)).alias("asked"))
                hits = self.table.join(near.unionByName(exact), "term").groupBy("key").agg(F.count_distinct("asked").alias("n"))
                return hits.filter(F.col("n") == len(terms)).select("key")
            for r in some:
                meant[r["asked"]].append(r["term"])
        if not all(meant):
            return self.table.filter(F.lit(False)).select("key")
        found = self.table.filter(F.col("term").isin(sorted({t for ts in meant for t in ts})))
        if len(meant) == len(meant[0]) == 1:
            return found.select("key")
        has = found.groupBy("key").agg(*[F.bool_or(F.col("term").isin(ts)).alias(f"h{i}") for i, ts in enumerate(meant)])
        return has.filter(" and ".join(f"h{i}" for i in range(len(meant)))).select("key")


def build(df: DataFrame, columns: list[str], key: str = "_key") -> Postings | None:
    """Postings of the columns' tokens together; None where rows share a key."""
    spark = ready(df.sparkSession)
    some = df.filter(F.coalesce(*[F.col(f"`{c}`") for c in columns]).isNotNull())
    n, keys = some.agg(F.count("*"), F.count_distinct(F.col(f"`{key}`"))).first()
    if n != keys:
        return None
    tokens = F.flatten(F.array(*[F.coalesce(T.tokens(F.col(f"c{i}")), F.array().cast("array<string>")) for i in range(len(columns))]))
    cores = spark.sparkContext.defaultParallelism
    rows = some.select(F.col(f"`{key}`").cast("string").alias("key"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores, "key")
    path = f"{folder(spark)}/postings-{uuid.uuid4().hex}"
    segments = rows.select("key", tokens.alias("t")).mapInArrow(_segments, "term string, key string, tf int, dl int")
    segments.write.option("parquet.block.size", 4 << 20).option("compression", "zstd").parquet(f"{path}/postings")
    table = spark.read.schema("term string, key string, tf int, dl int").parquet(f"{path}/postings")
    counts = table.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    counts.sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{path}/terms")
    terms = spark.read.schema("term string, df bigint, tf bigint").parquet(f"{path}/terms")
    words = terms.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    return Postings(table, terms.select("term", "df"), n, words / n if n else 0.0)


def _segments(batches):
    """Postings of batches of (key, t), sorted by term for every CHUNK tokens or a little more."""
    held, size = [], 0
    for batch in batches:
        lists = batch.column(1)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:  # a batch of long texts is cut between rows
            done = int(ends[at - 1]) if at else 0
            upto = min(batch.num_rows, int(np.searchsorted(ends, done + CHUNK - size)) + 1)
            held.append((batch.column(0).slice(at, upto - at), lists.slice(at, upto - at)))
            size, at = size + int(ends[upto - 1]) - done, upto
            if size >= CHUNK:
                yield from _sorted(held)
                held, size = [], 0
    yield from _sorted(held)


def _sorted(held):
    if not held:
        return
    keys, lists = (pa.concat_arrays(x) for x in zip(*held))
    n, length = len(keys), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), length)
    at, tf = np.unique(at, return_counts=True)
    words = coded.dictionary.take(pa.array(order))
    for lo in range(0, len(at), SENT):
        term, row = np.divmod(at[lo : lo + SENT], n)
        cols = [words.take(pa.array(term)), keys.take(pa.array(row)), pa.array(tf[lo : lo + SENT].astype(np.int32)), pa.array(length[row].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, ["term", "key", "tf", "dl"])


def signature(df: DataFrame, columns: list[str]) -> tuple | None:
    """What makes an index of df's files good for another frame like it; None if df isn't made of a few files."""
    files = df.inputFiles()
    if not 0 < len(files) <= 1000:
        return None
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    seen = []
    for f in files:
        status = (path := jvm.org.apache.hadoop.fs.Path(f)).getFileSystem(conf).getFileStatus(path)
        seen.append((f, status.getLen(), status.getModificationTime()))
    plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    return df.sparkSession.sparkContext.applicationId, plan, tuple(columns), tuple(sorted(seen))


def stored(df: DataFrame, columns: list[str], key: str = "_key") -> Postings | None:
    """The index of df's columns, built when it is first asked for and kept while the application and its files last."""
    name = signature(df.select(key, *columns), columns)
    if name is None:
        return build(df, columns, key)
    if name not in _BUILT:
        _BUILT[name] = build(df, columns, key)
    return _BUILT[name]
