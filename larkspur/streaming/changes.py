"""The change feed as a log of files, read with Structured Streaming.

publish() has an engine append one small JSON file per commit to a folder; feed() reads the folder as a stream;
live() runs a query again for each batch of commits that touches its collections. A stream's checkpoint makes it go
on where it ended, and a commit is seen once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine

SCHEMA = "at timestamp, collections array<string>, keys array<string>, edge_types array<string>"


def publish(engine: Engine, path: str) -> int:
    """Append each commit of the engine to the log; returns the subscription's number."""
    jvm, conf = engine.spark._jvm, engine.spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)

    def write(event: dict) -> None:
        import datetime

        row = {"at": datetime.datetime.now(datetime.UTC).isoformat(), **event}
        hidden = jvm.org.apache.hadoop.fs.Path(f"{path}/.{uuid.uuid4().hex}")
        out = fs.create(hidden)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        fs.rename(hidden, jvm.org.apache.hadoop.fs.Path(f"{path}/{uuid.uuid4().hex}.json"))  # readers see whole files only

    return engine.subscribe_changes(write)


def feed(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The log as a stream of (at, collections, keys, edge_types), one row per commit."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def live(engine: Engine, text: str, path: str, checkpoint: str, on_result: Callable[[DataFrame, int], None], collections: list[str] | None = None, params: list | None = None, once: bool = False) -> StreamingQuery:
    """Run a query for every batch of commits that touches one of the collections (any, if not given)."""

    def batch(commits: DataFrame, number: int) -> None:
        touched = commits.filter(F.arrays_overlap("collections", F.array(*[F.lit(c) for c in collections]))) if collections else commits
        if not touched.isEmpty():
            on_result(engine.sql(text, params), number)

    writer = feed(engine.spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def activity(changes: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Commits per collection and time window of a feed; state older than the watermark is let go."""
    each = changes.withWatermark("at", late).select("at", F.explode("collections").alias("collection"))
    return each.groupBy(F.window("at", window), "collection").agg(F.count("*").alias("commits")).select(F.col("window.start").alias("start"), "collection", "commits")
