"""Lempel-Ziv phrase fingerprints: documents that compress alike share dictionary phrases.

Each document is parsed from left to right into the phrases of an LZ78 dictionary over its words (lower case): each
phrase is the longest known one plus a word, and joins the dictionary. The set of phrases, as 64-bit hashes, is
the document's fingerprint; its signature has COORDINATES minimum hashes (fast similarity sketches, sketch.py), and
the share of coordinates in which two signatures agree estimates the Jaccard similarity of their phrase sets. Two
parses fall into step again soon after an edit, so near copies keep most phrases, while texts of one language share
few. Documents meet by banded signatures, are compared over the whole signatures, and are joined from THRESHOLD on
(near.py). Every document is a query.

Defined results: NULL, empty and blank texts have no phrases, fingerprint NULL and a group of their own. Very long
texts are parsed whole. Repeated rows get equal fingerprints and one group, named by its smallest doc_id (NULL if all
are NULL). An empty table gives no rows. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, near
from .sketch import bands, fast_sketches
from .words import TypeTable, word_hash

BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
THRESHOLD = 0.5

_TABLE = TypeTable(lambda words: word_hash([w.lower() for w in words], 33)[:, None] >> np.uint64(4), 1, kind=np.uint64)


def phrases(hashes: list[int]) -> set[int]:
    """Of a document's word hashes, below 2**60: the hashes of its LZ78 phrases."""
    seen: set[int] = set()
    add, at = seen.add, 0
    for x in hashes:
        at = (at * 1000003 ^ x) & 0xFFFFFFFFFFFFFFF
        if at not in seen:
            add(at)
            at = 0
    return seen


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_phrases, item, signature, buckets): item hashes the phrase set, signature is binary."""

    def run(batch):
        counts, items, rows, table = [], [], [], []
        for _, _, ids, lengths in _TABLE.groups(batch.column("text").to_pylist(), 400_000):
            words = _TABLE.values[ids, 0]
            ends, flat, sizes = np.cumsum(lengths), [], []
            for lo, hi in zip(ends - lengths, ends):
                own = phrases(words[lo:hi].tolist())
                flat.append(np.fromiter(own, np.uint64, len(own)))
                sizes.append(len(own))
                items.append(int(common.mix(flat[-1] * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64)) if own else None)
            sketch = fast_sketches(common.mix(np.concatenate(flat)), np.array(sizes), COORDINATES)
            counts += sizes
            rows += [s.tobytes() if n else None for s, n in zip((sketch ^ sketch >> np.uint64(32)).astype(np.uint32), sizes)]
            table.append(bands(sketch, ROWS))
        buckets = np.concatenate(table)
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_phrases": counts, "item": items, "signature": rows, "buckets": common.list_array(buckets.ravel(), np.full(len(buckets), BANDS), pa.int64())}

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_key("text").alias("key"), "text")
    return common.map_arrow(slim, run, "doc_id bigint, key binary, n_phrases int, item bigint, signature binary, buckets array<bigint>")


def agreement(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs (a, b) with `similarity`: the share of coordinates in which the signatures agree."""

    def run(batch):
        read = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, COORDINATES)
        return {"a": batch.column("a"), "b": batch.column("b"), "similarity": (read("x") == read("y")).mean(1)}

    left = items.select(F.col("item").alias("a"), F.col("signature").alias("x"))
    right = items.select(F.col("item").alias("b"), F.col("signature").alias("y"))
    return common.map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a bigint, b bigint, similarity double")


def fingerprints(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_phrases, fingerprint, group_doc_id): the phrase set's hash, and the group's smallest doc_id."""
    rows = common.written(signed(docs), "signatures")
    first = rows.filter("item is not null").groupBy("item").agg(F.first("signature").alias("signature"), F.first("buckets").alias("buckets"))
    items = common.written(first, "items")
    members = items.select(F.explode("buckets").alias("bucket"), "item")
    edges = near.similar_stars(members, lambda pairs: agreement(pairs, items).filter(F.col("similarity") >= threshold).select("a", "b"))
    grouped = near.grouped(rows.select("doc_id", "key", "n_phrases", "item"), edges)
    return near.with_kept(grouped, "n_phrases", "item").select("doc_id", "n_phrases", F.col("item").alias("fingerprint"), F.col("kept_doc_id").alias("group_doc_id"))


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.load(spark, sf_dir, "documents", spread=True))
