"""MinHash near-dedup by fast similarity sketches, banding and exact verification.

A document's set is its runs of SHINGLE words (lower case, split at white space), as 64-bit hashes; a shorter text
is one run. Documents of equal sets are one item. Items' sketches of BANDS * ROWS coordinates (sketch.py) are cut
into bands; items that share a band meet in a bucket, are compared by the Jaccard similarity of their whole sets,
and are joined from THRESHOLD on; groups are the connected components (near.py). At a similarity of 0.5 two
documents meet with a chance of 0.78, at 0.6 of 0.98, at 0.7 of 0.9998, and once is enough within a group.

Defined results: NULL, empty and blank texts are near duplicates of nothing. Very long texts are taken whole, as are
very long words. Repeated rows and exact copies are one group. Equal sets are known by 64 bits of their hashes' sum. Of a group the row of the smallest doc_id stays (NULL last; among rows of one doc_id one of them). An empty
table gives no rows. Columns other than doc_id and text are left alone, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, near
from .exact_dedup import keep_rows
from .sketch import bands, fast_sketches
from .words import TypeTable, word_hash

SHINGLE = 3
BANDS, ROWS = 48, 5
THRESHOLD = 0.5

_TABLE = TypeTable(lambda words: word_hash([w.lower() for w in words], 21)[:, None], 1, kind=np.uint64)


def shingles(texts: list[str | None]):
    """Per group of texts: first, last + 1, hashes of the runs of words end to end, runs per text."""
    for lo, hi, ids, lengths in _TABLE.groups(texts, 400_000):
        n = hi - lo
        spread = np.zeros(len(ids) + (SHINGLE - 1) * n, np.uint64)
        doc = np.repeat(np.arange(n), lengths)
        spread[np.arange(len(ids)) + (SHINGLE - 1) * doc] = _TABLE.values[ids, 0]
        m = len(spread) - SHINGLE + 1
        h = np.zeros(max(m, 0), np.uint64)
        for j in range(SHINGLE):
            h = h * np.uint64(0x9E3779B97F4A7C15) + spread[j : j + m]
        counts = np.where(lengths > 0, np.maximum(lengths - SHINGLE + 1, 1), 0)
        first = np.cumsum(lengths) - lengths + (SHINGLE - 1) * np.arange(n)
        at = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
        yield lo, hi, common.mix(h[at]), counts


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, key, item, buckets): item stands for the document's set."""

    def run(batch):
        items, tables = [], []
        for _, _, h, counts in shingles(batch.column("text").to_pylist()):
            ends = np.cumsum(counts)
            for lo, hi in zip(ends - counts, ends):
                u = np.unique(h[lo:hi])
                with np.errstate(over="ignore"):
                    items.append(int((common.mix(u * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) ^ np.uint64(len(u))).view(np.int64)) if hi > lo else None)
            tables.append(np.where((counts > 0)[:, None], bands(fast_sketches(h, counts, BANDS * ROWS), ROWS), 0))
        table = np.concatenate(tables)
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "item": items, "buckets": common.list_array(table.ravel(), np.full(len(table), BANDS), pa.int64())}

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_key("text").alias("key"), "text")
    return common.map_arrow(slim, run, "doc_id bigint, key binary, item bigint, buckets array<bigint>")


def _sets(texts: DataFrame) -> DataFrame:
    """(item, runs) of (item, text): the sorted distinct hashes."""

    def run(batch):
        out, sizes = [], []
        for _, _, h, counts in shingles(batch.column("text").to_pylist()):
            ends = np.cumsum(counts)
            for lo, hi in zip(ends - counts, ends):
                out.append(np.unique(h[lo:hi]).view(np.int64))
                sizes.append(len(out[-1]))
        return {"item": batch.column("item"), "runs": common.list_array(np.concatenate(out), np.array(sizes), pa.int64())}

    return common.map_arrow(texts, run, "item bigint, runs array<bigint>")


def _verifier(docs: DataFrame, items: DataFrame, threshold: float):
    """A function that keeps the pairs (a, b) of items that are similar; the sets are made anew from those texts only."""
    store: list[DataFrame] = []

    def sets(pairs: DataFrame) -> DataFrame:
        if not store:  # later rounds only have items of the first
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct()
            rows = items.join(wanted, "item", "left_semi").select("item", F.isnull("doc_id").alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("key").alias("_key"))
            doc_id = F.col("doc_id").cast("bigint")
            texts = docs.select(F.isnull(doc_id).alias("_none"), F.coalesce(doc_id, F.lit(0)).alias("_id"), common.text_key("text").alias("_key"), "text")
            store.append(common.written(_sets(texts.join(rows, ["_none", "_id", "_key"]).select("item", "text")).dropDuplicates(["item"]), "sets"))
        return store[0]

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = common.written(pairs, "pairs")
        found = sets(pairs)
        left = found.select(F.col("item").alias("a"), F.col("runs").alias("x"))
        right = found.select(F.col("item").alias("b"), F.col("runs").alias("y"))
        both = pairs.join(right, "b").join(left, "a").withColumn("n", F.size(F.array_intersect("x", "y")))
        return both.filter(F.col("n") >= threshold * (F.size("x") + F.size("y") - F.col("n"))).select("a", "b")

    return verify


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, item, root) of each row: root is the same in a group of near duplicates, NULL without a set."""
    rows = common.written(_sketched(docs), "sketches")
    first = rows.filter("item is not null").groupBy("item").agg(F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "key", "buckets")).alias("r"))
    items = common.written(first.select("item", "r.doc_id", "r.key", "r.buckets"), "items")
    members = items.select(F.explode("buckets").alias("bucket"), "item")
    edges = near.similar_stars(members, _verifier(docs, items.select("item", "doc_id", "key"), threshold))
    return near.grouped(rows.select("doc_id", "key", "item"), edges)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id) of each row: the smallest doc_id of its group of near duplicates."""
    return near.with_kept(groups(docs))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each group of near duplicates."""
    return keep_rows(docs, near.kept_rows(groups(docs)))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(common.load(spark, sf_dir, "documents", spread=True))
