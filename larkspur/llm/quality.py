"""A quality classifier with supervised subword embeddings.

Each word type has a vector, the mean of learned vectors of its features: itself and its character n-grams, hashed
into BUCKETS rows. A document's vector is the average over its words, and a softmax layer turns it into class
probabilities. Vectors and layer are learned together by numpy stochastic gradient descent on the cross-entropy of
labelled documents; since both are linear up to the softmax, scoring needs one number per word type and class.

The training sample is at most about SAMPLE_DOCS labelled documents, those of the smallest hashes of doc_id; a fifth
of it isn't trained on but sets the threshold: the score above which KEEP_RECALL of the good ones stay. Scoring
takes every document, whole.

Defined results: NULL, empty and blank texts have probability NULL and aren't kept. Very long texts are scored whole. A
score at the threshold is kept. Rows without a doc_id are scored, but not trained on. A doc_id with several labels
counts by the least; labels that are NULL or without a document are ignored. Where no label or only one class is
known, every document with words has probability NULL and is kept. Repeated rows are scored each for itself; an
empty table gives no rows; other columns, of any names, are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import Marks, TypeTable, features, slices, sums

SAMPLE_DOCS = 4000
BUCKETS = 1 << 17
DIM = 12
GRAMS = (3, 4)
KEEP_RECALL = 0.99


class Model:
    """Per feature a vector, and the softmax layer; only their product is kept for scoring."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, threshold: float):
        self.table, self.bias, self.threshold = table, bias, threshold

    def type_logits(self, words: list[str]) -> np.ndarray:
        flat, counts = features(words, BUCKETS, GRAMS)
        return sums(self.table, flat, counts) / counts[:, None]

    def probabilities(self, logits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of class 1, from the sums of the documents' word logits."""
        z = logits / np.maximum(lengths, 1)[:, None] + self.bias
        return 1 / (1 + np.exp(z[:, 0] - z[:, 1]))


def train(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.5, batch: int = 32, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    types: dict[str, int] = {}
    docs = [np.fromiter((types.setdefault(w, len(types)) for w in t.split()), np.int64) for t in texts]
    flat, counts = features(list(types), BUCKETS, GRAMS)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    y = np.array(labels)
    held = rng.random(len(docs)) < 0.2 if len(docs) >= 50 else np.zeros(len(docs), bool)
    e = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, 2)), np.zeros(2)
    seen_e, seen_w, seen_b = np.full((BUCKETS, 1), 1e-6, np.float32), np.full(w.shape, 1e-6), np.full(2, 1e-6)
    marks, type_marks = Marks(BUCKETS), Marks(len(types))
    pool = np.array([i for i in np.flatnonzero(~held) if len(docs[i])])
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(pool), max(1, len(pool) // batch)):
            doc = np.repeat(np.arange(len(part)), [len(docs[i]) for i in part])
            used, at = type_marks.distinct(np.concatenate([docs[i] for i in part]))
            own = slices(flat, offsets, used)
            n = counts[used]
            vectors = sums(e, own, n) / n[:, None]
            share = 1 / np.bincount(doc, minlength=len(part))
            hidden = np.stack([np.bincount(doc, vectors[at, d], len(part)) for d in range(DIM)], 1) * share[:, None]
            z = hidden @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            back = (p @ w.T) * share[:, None]
            per_type = np.stack([np.bincount(at, back[doc, d], len(used)) for d in range(DIM)], 1) / n[:, None]
            rows, inverse = marks.distinct(own)
            spread = np.repeat(np.arange(len(used)), n)
            grad = np.stack([np.bincount(inverse, per_type[spread, d], len(rows)) for d in range(DIM)], 1)
            seen_e[rows] += (grad**2).mean(1, keepdims=True)
            e[rows] -= rate * grad / np.sqrt(seen_e[rows])
            gw, gb = hidden.T @ p, p.sum(0)
            seen_w += gw**2
            seen_b += gb**2
            w -= rate * gw / np.sqrt(seen_w)
            bias -= rate * gb / np.sqrt(seen_b)
    model = Model((e @ w).astype(np.float32), bias, 0.5)
    judged = held if held.any() else ~held
    scores = np.sort(score(model, [t for t, h in zip(texts, judged) if h])[y[judged] == 1])
    if len(scores):
        model.threshold = float(min(0.5, scores[int(len(scores) * (1 - KEEP_RECALL))]))
    return model


def score(model: Model, texts: list[str | None], table: TypeTable | None = None) -> np.ndarray:
    """Probability of class 1 of each text, NaN without words."""
    table, out = table or TypeTable(model.type_logits, 2), []
    for lo, hi, ids, lengths in table.groups(texts):
        doc, values = np.repeat(np.arange(hi - lo), lengths), table.values
        logits = np.stack([np.bincount(doc, values[ids, c], hi - lo) for c in range(2)], 1)
        out.append(np.where(lengths > 0, model.probabilities(logits, lengths), np.nan))
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model of labels (doc_id, quality), or None if they don't hold two classes."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = common.bounded_sample(known, F.col("doc_id"), sample_docs)
    texts = docs.filter("length(text) > 0").select("doc_id", "text")
    rows = texts.join(F.broadcast(known), "doc_id").orderBy("doc_id", common.text_key("text")).collect()
    y = [int(r["quality"] > 0) for r in rows]
    return train([r["text"] for r in rows], y) if 0 < sum(y) < len(y) else None


_LIVE: dict[int, TypeTable] = {}


def quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, quality, keep) of each row: the probability of being good, and whether it passes the threshold."""
    spark = common.ready(docs.sparkSession)
    if model is None:
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("double").alias("quality"), F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("keep"))
    shared = spark.sparkContext.broadcast((np.random.default_rng().integers(1 << 62), model))

    def run(batch):
        number, m = shared.value
        if number not in _LIVE:
            _LIVE.clear()
            _LIVE[number] = TypeTable(m.type_logits, 2)
        p = score(m, batch.column("text").to_pylist(), _LIVE[number])
        return {"doc_id": batch.column("doc_id"), "quality": pa.array(np.round(p, 6), mask=np.isnan(p)), "keep": p >= m.threshold}

    return common.map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, quality double, keep boolean")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents", spread=True)
    return quality(docs, fit(docs, common.load(spark, sf_dir, "labels")))
