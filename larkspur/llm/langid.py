"""Language ID by a linear-chain conditional random field over words.

Each word has a score for each language, the sum of learned weights of its features: its hashed character n-grams,
prefixes and suffixes, itself, and the lexicons it stands in. Learned transitions tie neighbouring words together,
and forward-backward gives every word its posterior over languages, so that text which switches language within a
document is labelled word by word. A document gets the language with the largest share of its words; it is rejected
if it has no word with a letter or no language has MIN_SHARE of them.

Training is numpy gradient ascent (AdaGrad) on the exact log-likelihood, over a sample of at most about
SAMPLE_DOCS documents that have a `lang`: half as they are, half cut into spans that alternate between documents of
two languages. The model is BUCKETS x languages floats, whatever the corpus.

Forward-backward is exact for any length: texts are cut into blocks of words, each block's transfer matrix is
multiplied out for all blocks at once, a scan over the blocks of each document links them, and the vectors within
the blocks follow. No Python loop runs over words.

Defined results: NULL, empty and letterless texts have lang NULL, share 0, no spans and are rejected. Words without
letters follow their neighbours and don't count. With no labelled document everything is rejected. Of languages
with equal shares the first by name wins. Very long texts are labelled whole, and rows without a doc_id like others.
Repeated rows are labelled each for itself, an empty table gives no rows, columns of other names stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import Marks, TypeTable, features, slices, sums, word_hash

SAMPLE_DOCS = 1200
BUCKETS = 1 << 17
MIN_SHARE = 0.4
LEXICON = 2000
BLOCK = 16
NOT_LETTERS = re.compile(r"[\W\d_]+")


def normal(words: list[str]) -> list[str]:
    return [NOT_LETTERS.sub("", w).lower() for w in words]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posterior (words x labels) of sequences laid end to end; with pairs, also the expected transitions."""
    n, k = scores.shape
    if not n:
        return (scores, np.zeros((k, k))) if pairs else scores
    lengths = lengths[lengths > 0]
    psi = np.exp(scores - scores.max(1, keepdims=True))
    a, pi = np.exp(trans), np.exp(start)
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    nb = int(blocks.sum())
    slot = np.arange(n) + np.repeat(first * BLOCK - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    live = np.zeros(nb * BLOCK, bool)
    live[slot] = True
    p = np.ones((nb * BLOCK, k))
    p[slot] = psi
    p, live = p.reshape(nb, BLOCK, k).transpose(1, 0, 2).copy(), live.reshape(nb, BLOCK).T.copy()
    # transfer matrices of whole blocks
    m = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for j in range(BLOCK):
        if j == 0:
            m = np.broadcast_to(a, (nb, k, k)) * p[0][:, None, :]
            m[first] = (pi * p[0][first])[:, None, :]
        else:
            m = np.where(live[j][:, None, None], (m.reshape(-1, k) @ a).reshape(nb, k, k) * p[j][:, None, :], m)
        m /= m.max((1, 2), keepdims=True)
    # vectors at the blocks' borders
    order = np.argsort(-blocks, kind="stable")
    firsts, counts = first[order], blocks[order]
    fore, back = np.zeros((nb, k)), np.ones((nb, k))
    fore[first] = 1.0 / k
    for b in range(1, int(counts[0])):
        at = firsts[: np.searchsorted(-counts, -b, side="left")] + b
        v = np.einsum("ni,nij->nj", fore[at - 1], m[at - 1])
        fore[at] = v / v.sum(1, keepdims=True)
    for b in range(int(counts[0]) - 1, 0, -1):
        at = firsts[: np.searchsorted(-counts, -b, side="left")] + b
        v = np.einsum("nij,nj->ni", m[at], back[at])
        back[at - 1] = v / v.sum(1, keepdims=True)
    # and within them
    alpha, beta = np.empty_like(p), np.empty_like(p)
    v = fore
    for j in range(BLOCK):
        u = (v @ a) * p[j]
        if j == 0:
            u[first] = pi * p[0][first]
        u /= u.sum(1, keepdims=True)
        v = alpha[j] = np.where(live[j][:, None], u, v)
    v = back
    for j in range(BLOCK - 1, -1, -1):
        beta[j] = v
        u = (p[j] * v) @ a.T
        v = np.where(live[j][:, None], u / u.sum(1, keepdims=True), v)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    flat = lambda x: x.transpose(1, 0, 2).reshape(-1, k)[slot]
    if not pairs:
        return flat(gamma)
    al, right = flat(alpha), psi * flat(beta)
    inner = np.ones(n, bool)
    inner[np.cumsum(lengths) - lengths] = False
    to = np.flatnonzero(inner)
    z = np.einsum("ni,ij,nj->n", al[to - 1], a, right[to])
    return flat(gamma), np.einsum("ni,nj->ij", al[to - 1] / z[:, None], right[to]) * a


class Crf:
    """langs, weights (BUCKETS + lexicons) x languages, transitions, starts, lexicons as sorted word hashes."""

    def __init__(self, langs, weights, trans, start, lexicons):
        self.langs, self.weights, self.trans, self.start, self.lexicons = langs, weights, trans, start, lexicons

    def word_features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of normalised words; letterless ones have no feature."""
        flat, counts = features(words, BUCKETS, (1, 2, 3), affixes=4)
        hashes = word_hash(words)
        rows, cols = [np.repeat(np.arange(len(words)), counts)], [flat]
        for i, lexicon in enumerate(self.lexicons):
            if len(lexicon):
                at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
                r = np.flatnonzero(lexicon[at] == hashes)
                rows.append(r)
                cols.append(np.full(len(r), BUCKETS + i))
        row, col = np.concatenate(rows), np.concatenate(cols)
        letters = np.fromiter(map(bool, words), bool, len(words))
        keep = letters[row]
        row, col = row[keep], col[keep]
        order = np.argsort(row, kind="stable")
        return col[order], np.bincount(row, minlength=len(words))

    def type_scores(self, words: list[str]) -> np.ndarray:
        """Scores of raw words, and whether they have letters."""
        norm = normal(words)
        distinct: dict[str, int] = {}
        at = np.fromiter((distinct.setdefault(w, len(distinct)) for w in norm), np.int64, len(norm))
        names = list(distinct)
        flat, counts = self.word_features(names)
        out = np.concatenate([sums(self.weights, flat, counts), np.fromiter(map(bool, names), float, len(names))[:, None]], 1)
        return out[at]


def train(texts: list[str], langs: list[str], epochs: int = 3, rate: float = 0.3, seed: int = 5) -> Crf:
    names = sorted(set(langs))
    k, rng = len(names), np.random.default_rng(seed)
    table: dict[str, int] = {}
    docs = []
    for text, lang in zip(texts, langs):
        norm = [w for w in normal(text.split()) if w]
        ids = np.fromiter((table.setdefault(w, len(table)) for w in norm), np.int64, len(norm))
        if len(ids):
            docs.append((ids, names.index(lang)))
    words = list(table)
    seen = np.zeros((len(words), k))
    for ids, y in docs:
        np.add.at(seen, (ids, y), 1)
    hashes = word_hash(words)
    lexicons = []
    for y in range(k):
        own = np.flatnonzero((seen[:, y] >= 3) & (seen[:, y] >= 0.8 * seen.sum(1)))
        lexicons.append(np.sort(hashes[own[np.argsort(-seen[own, y], kind="stable")][:LEXICON]]))
    crf = Crf(names, np.zeros((BUCKETS + k, k), np.float32), np.zeros((k, k)), np.zeros(k), lexicons)
    flat, counts = crf.word_features(words)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    marks, type_marks = Marks(len(crf.weights)), Marks(len(words))
    squares, squares_t = np.full(crf.weights.shape, 1e-8, np.float32), np.full((k, k), 1e-8)
    for _ in range(epochs if k > 1 else 0):
        batch_ids, batch_y, lengths = [], [], []
        order = rng.permutation(len(docs))
        for step, i in enumerate(order):
            ids, y = docs[i]
            if step % 2:  # switch between two documents
                other, z = docs[order[rng.integers(len(order))]]
                cut = lambda x: np.split(x, np.sort(rng.integers(0, len(x) + 1, len(x) // 25)))
                spans = [(s, u) for pair in zip(cut(ids), cut(other)) for s, u in zip(pair, (y, z)) if len(s)] or [(ids, y)]
                ids, ys = np.concatenate([s for s, _ in spans]), np.concatenate([np.full(len(s), u) for s, u in spans])
            else:
                ys = np.full(len(ids), y)
            batch_ids.append(ids)
            batch_y.append(ys)
            lengths.append(len(ids))
            if sum(lengths) < 20_000 and step < len(order) - 1:
                continue
            ids, ys, lens = np.concatenate(batch_ids), np.concatenate(batch_y), np.array(lengths)
            batch_ids, batch_y, lengths = [], [], []
            used, at = type_marks.distinct(ids)
            part = slices(flat, offsets, used)
            scores = sums(crf.weights, part, counts[used])[at]
            gamma, xi = forward_backward(scores, lens, crf.trans, crf.start, pairs=True)
            inner = np.ones(len(ids), bool)
            inner[np.cumsum(lens) - lens] = False
            to = np.flatnonzero(inner)
            np.add.at(xi, (ys[to - 1], ys[to]), -1.0)
            gamma[np.arange(len(ids)), ys] -= 1
            per_type = np.stack([np.bincount(at, gamma[:, y], len(used)) for y in range(k)], 1)
            distinct, inverse = marks.distinct(part)
            spread = np.repeat(np.arange(len(used)), counts[used])
            grad = np.stack([np.bincount(inverse, per_type[spread, y], len(distinct)) for y in range(k)], 1)
            squares[distinct] += grad**2
            crf.weights[distinct] -= rate * grad / np.sqrt(squares[distinct])
            squares_t += xi**2
            crf.trans -= rate * xi / np.sqrt(squares_t)
    return crf


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Crf:
    """Train on the documents that have a lang."""
    labelled = docs.filter("lang is not null and length(text) > 0").select("doc_id", "lang", "text")
    rows = common.bounded_sample(labelled, F.col("doc_id"), sample_docs).orderBy("doc_id", common.text_key("text"), "lang").collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


class Labeller:
    def __init__(self, crf: Crf):
        self.crf = crf
        self.table = TypeTable(crf.type_scores, len(crf.langs) + 1)

    def label(self, texts: list[str | None]):
        """Per group of texts: first, last + 1, shares (texts x languages), counted words, labels and lengths."""
        k = len(self.crf.langs)
        for lo, hi, ids, lengths in self.table.groups(texts):
            values = self.table.values[ids]
            gamma = forward_backward(values[:, :k].astype(np.float64), lengths, self.crf.trans, self.crf.start)
            doc = np.repeat(np.arange(hi - lo), lengths)
            counted = np.bincount(doc, values[:, k], hi - lo)
            shares = np.stack([np.bincount(doc, gamma[:, y] * values[:, k], hi - lo) for y in range(k)], 1) / np.maximum(counted, 1)[:, None]
            yield lo, hi, shares, counted, gamma.argmax(1), lengths


_LIVE: dict[int, Labeller] = {}


def _labeller(shared) -> Labeller:
    """One labeller for each model and Python worker: the word types it has met stay known between tasks."""
    if shared.value[0] not in _LIVE:
        _LIVE.clear()
        _LIVE[shared.value[0]] = Labeller(shared.value[1])
    return _LIVE[shared.value[0]]


def _shared(spark: SparkSession, crf: Crf):
    return common.ready(spark).sparkContext.broadcast((np.random.default_rng().integers(1 << 62), crf))


def languages(docs: DataFrame, crf: Crf) -> DataFrame:
    """(doc_id, lang, share, rejected, spans) of each row; spans are runs of words of one language."""
    schema = "doc_id bigint, lang string, share double, rejected boolean, spans array<struct<first:int,last:int,lang:string>>"
    if not crf.langs:
        return docs.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("share"), F.lit(True).alias("rejected"), F.array().cast("array<struct<first:int,last:int,lang:string>>").alias("spans"))
    shared = _shared(docs.sparkSession, crf)

    def run(batch):
        model, langs = _labeller(shared), np.array(crf_langs, object)
        lang, share, rejected, firsts, lasts, runs, counts = [], [], [], [], [], [], []
        for lo, hi, shares, counted, labels, lengths in model.label(batch.column("text").to_pylist()):
            best = shares.argmax(1)
            top = shares[np.arange(hi - lo), best]
            lang += [langs[b] if c else None for b, c in zip(best, counted)]
            share.append(np.where(counted > 0, np.round(top, 6), 0.0))
            rejected.append((counted == 0) | (top < MIN_SHARE))
            start = np.cumsum(lengths) - lengths
            doc = np.repeat(np.arange(hi - lo), lengths)
            change = np.ones(len(labels), bool)
            change[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(change & (counted[doc] > 0))
            ends = np.flatnonzero(np.append(change[1:], True) & (counted[doc] > 0)) if len(labels) else at
            firsts.append(at - start[doc[at]])
            lasts.append(ends - start[doc[ends]])
            runs.append(labels[at])
            counts.append(np.bincount(doc[at], minlength=hi - lo))
        struct = pa.StructArray.from_arrays([pa.array(np.concatenate(firsts), pa.int32()), pa.array(np.concatenate(lasts), pa.int32()), pa.array(langs[np.concatenate(runs)], pa.string())], ["first", "last", "lang"])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return {"doc_id": batch.column("doc_id"), "lang": lang, "share": np.concatenate(share), "rejected": np.concatenate(rejected), "spans": pa.ListArray.from_arrays(pa.array(offsets), struct)}

    crf_langs = list(crf.langs)
    return common.map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, schema)


def drop_rejected(docs: DataFrame, crf: Crf) -> DataFrame:
    """The rows of docs, with all their columns, less those that languages() rejects."""
    if not crf.langs:
        return docs.limit(0)
    shared = _shared(docs.sparkSession, crf)

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        out = [(counted > 0) & (shares.max(1) >= MIN_SHARE) for _, _, shares, counted, _, _ in _labeller(shared).label(texts.tolist())]
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.filter(kept("text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents", spread=True)
    return languages(docs, fit(docs))
