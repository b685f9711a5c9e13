"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of fixed size. Equal blocks get one integer name by sorting; names of adjacent blocks
form pairs, which are sorted and named in turn, until one name is left of each document: its identity. Two
documents have one identity if and only if their bytes are the same; no hash decides.

A name is rank * buckets + bucket: the rank is the place among the distinct blocks of a bucket of hashes, sorted by
hash and block. Each task first reduces its blocks to distinct ones, compared whole, so a block that a third of all
rows have crosses the network once a task. Where a hash has one block, as nearly always, the blocks needn't move again:
the hashes are ranked, and the rows look their names up by hash. Where it has several, blocks are ranked and looked up
whole, into names below 0. Pairs are ranked by their two names and looked up by them. Every level halves the blocks,
documents leave when one name is left, and each level is written to the shared folder.

Defined results: NULL text is one content of its own, apart from the empty text. Repeated rows of any length are
copies of each other and stay rows; of a group the row of the smallest doc_id stays (NULL last), and one of them if
it has that doc_id twice. Very long texts only have more blocks and levels. An empty table gives no rows. Columns
other than doc_id and text are left alone, whatever their names. drop_copies tells rows of one doc_id apart by 128
bits of their texts.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 4096
BUCKET_ROWS = 100_000


def _ranked(distinct: DataFrame, buckets: int, *order: str) -> DataFrame:
    """distinct rows with a hash, and `name`: an integer above 0 for each, by sorting the rows of a bucket of hashes."""
    rows = distinct.withColumn("_bucket", F.pmod("hash", F.lit(buckets)))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return rows.withColumn("name", rank.cast("bigint") * buckets + F.col("_bucket")).drop("_bucket")


def _blocks_named(cut: DataFrame, blocks: DataFrame, buckets: int) -> DataFrame:
    """cut (hash, content, ...) with the name of content, 0 if it is NULL; blocks has the contents that aren't NULL."""
    distinct = blocks.select("hash", "content").distinct()
    kinds = common.written(distinct.groupBy("hash").agg(F.count("*").alias("kinds")), "hashes")
    names = _ranked(kinds.filter("kinds = 1").select("hash"), buckets, "hash")
    plain = cut.drop("content").join(names, "hash", "left").withColumn("name", F.coalesce("name", F.lit(0)))
    several = kinds.filter("kinds > 1").select("hash")
    if several.isEmpty():
        return plain
    own = _ranked(distinct.join(several, "hash", "left_semi"), buckets, "hash", "content").withColumn("name", -F.col("name"))
    whole = cut.join(several, "hash", "left_semi").join(own, ["hash", "content"]).drop("content")
    return plain.join(several, "hash", "left_anti").unionByName(whole)


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """(doc_id, key, identity) of each row; key is common.text_key. Fewer hash_bits are for tests of equal hashes."""
    raw = F.col("text").cast("binary")
    last = F.greatest(F.octet_length("text") - 1, F.lit(0))
    rows, total, longest = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max(last), F.lit(0))).first()
    blocks = F.when(F.col("text").isNull(), F.array(F.lit(None).cast("binary"))).otherwise(
        F.transform(F.sequence(F.lit(0), (last / block_bytes).cast("int")), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))
    )
    hashed = F.when(F.col("content").isNotNull(), F.xxhash64("content") if hash_bits == 64 else F.pmod(F.xxhash64("content"), F.lit(1 << hash_bits))).alias("hash")
    cut = docs.select("doc_id", common.text_key("text").alias("key"), F.size(blocks).alias("n"), F.posexplode(blocks).alias("pos", "content")).select("*", hashed)
    contents = docs.filter("text is not null").select(F.explode(blocks).alias("content")).select(hashed, "content")
    named = _blocks_named(cut, contents, max(1, ceil((rows + total / block_bytes) / BUCKET_ROWS)))
    # repeated rows become one from the first pairs on; copies says how many they were
    level = common.written(named.select("doc_id", "key", "n", "pos", "name", F.lit(1).cast("bigint").alias("copies")), "blocks")
    found: DataFrame | None = None
    left, count = longest // block_bytes + 1, rows + total // block_bytes
    for depth in range(64):
        ended = level.filter("n = 1").select("doc_id", "key", (F.col("name") * 64 + depth).alias("identity"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
        found = ended if found is None else found.unionByName(ended)
        if left == 1:
            break
        left, count = (left + 1) // 2, count // 2 + 1
        right = F.col("pos") % 2 == 1
        pairs = (
            level.filter("n > 1")
            .groupBy("doc_id", "key", ((F.col("n") + 1) / 2).cast("int").alias("n"), (F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(~right, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(-1)).alias("b"), F.sum(F.when(~right, F.col("copies"))).alias("copies"))
        )
        pairs = common.written(pairs, "pairs")
        names = _ranked(pairs.select(F.xxhash64("a", "b").alias("hash"), "a", "b").distinct(), max(1, count // BUCKET_ROWS), "a", "b")
        level = common.written(pairs.join(names.drop("hash"), ["a", "b"]).select("doc_id", "key", "n", "pos", "name", "copies"), "names")
    return found


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id) for each row: the smallest doc_id that has the same text."""
    found = common.written(identities(docs).select("doc_id", "identity"), "identities")
    kept = found.groupBy("identity").agg(F.min("doc_id").alias("kept_doc_id"))
    return found.join(kept, "identity").select("doc_id", "kept_doc_id")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each group of equal texts."""
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("_id"), F.col("key").alias("_key")))
    return keep_rows(docs, identities(docs).groupBy("identity").agg(least.alias("row")).select("row._id", "row._key"))


def keep_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Of docs one row for each distinct row (_id, _key) of keep: the doc_id and common.text_key of the row to keep.

    Rows meet by doc_id and 128 bits of the text, and the texts cross the network once, also for dropping repeats.
    """
    by = ["_none", "_id", "_key"]
    of = lambda i, k: (F.isnull(i).alias("_none"), F.coalesce(i, F.lit(0)).alias("_id"), k.alias("_key"))
    rows = docs.select(F.struct("*").alias("row"), *of(F.col("doc_id"), common.text_key("text")))
    wanted = keep.select(*of(F.col("_id"), F.col("_key")))
    return rows.join(wanted.hint("shuffle_merge"), by, "left_semi").dropDuplicates(by).select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(common.load(spark, sf_dir, "documents"))


SQL = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_doc_id FROM documents"
