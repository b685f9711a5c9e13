"""Language-model scoring by a weighted backoff automaton over word n-grams, kept in parts.

Symbols are words (lower case, split at white space); a text has two start marks before it and an end mark behind it.
All n-grams of up to ORDER symbols of the whole corpus are counted, without a cutoff, and smoothed by a Dirichlet prior
of PRIOR symbols that follow the shorter history's distribution:

    p(c | h) = (n(hc) + PRIOR * p(c | h without its first symbol)) / (n(h) + PRIOR),

down to a uniform distribution over the corpus' words, the end mark and one unknown word. The automaton has a state
for each seen history h, an arc for each seen hc, which leads to the longest seen history that ends hc, and a failure
arc from h to the shorter history with weight log(PRIOR / (n(h) + PRIOR)). One traversal from left to right carries
the state and adds up log-probabilities: the arc's if there is one, else failure arcs' until there is. The last
ORDER - 1 symbols determine the state, so all places of a text are followed at once.

A document of the corpus is scored by the automaton of all others: what it counts itself is taken off its arcs and
states, else its own n-grams would make any text likely. A copy is another document.

No task or driver holds the automaton. A chunk of documents (about CHUNK_WORDS words, as each task reads them) is kept
as numbers of words; its distinct n-grams, as sorted hashes with their counts, go to parts by ranges of the hash; a
part of at most about PART_GRAMS n-grams adds up and answers each chunk with the corpus' counts, in the chunk's order.
A hash has common.SPARE_BITS more bits than the corpus' n-grams need, so at any size an n-gram has another's with a chance of
one in 2**SPARE_BITS. A frequent n-gram is one number a chunk, so parts are even. What is gathered grows with the input,
and nothing is broadcast. (Cells of a chunk and a part shrink as both grow in number: beyond a TB give both more memory.)

Defined results: NULL text has no score (NULLs). The empty text is one end mark. Repeated rows count and are scored
each for itself, as are rows without a doc_id. Very long texts are scored whole, in a chunk of their own if need be.
In a corpus of one document its words are unknown. An empty table gives no rows. Other columns are left alone,
whatever their names.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import key_bits, opened, squeezed
from .words import Types, word_hash

ORDER = 3
PRIOR = 2.0
CHUNK_WORDS = 2_000_000
PART_GRAMS = 2_000_000
CHUNK = "chunk bigint, ids array<bigint>, lengths array<int>, types binary, words binary"
_MARKS = np.array([0x5354415254303030, 0x5354415254303031, 0x454E443030303030], np.uint64)  # starts, end


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents in chunks: their words' numbers end to end, the hash of each number; NULL texts have length -1."""

    def row(number, ids, lengths, words, types):
        flat = np.concatenate(words)
        by_use = np.argsort(-np.bincount(flat, minlength=len(types)), kind="stable")
        rank = np.empty(len(types), np.uint32)
        rank[by_use] = np.arange(len(types), dtype=np.uint32)
        cells = (number, ids, lengths, squeezed(word_hash(list(types))[by_use]), squeezed(rank[flat]))
        return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(cells, arrow)], schema=arrow)

    def run(batches):
        number, ids, lengths, words, types, size = pyspark.TaskContext.get().partitionId() << 20, [], [], [], Types(), 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and size + (len(text) if text else 0) // 6 > CHUNK_WORDS:
                    yield row(number, ids, lengths, words, types)
                    number, ids, lengths, words, types, size = number + 1, [], [], [], Types(), 0
                ids.append(i)
                words.append(types.ids(text.lower() if text else text))
                lengths.append(-1 if text is None else len(words[-1]))
                size += len(words[-1])
        if ids:
            yield row(number, ids, lengths, words, types)

    arrow = common.arrow_schema(CHUNK)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, CHUNK)


class Stream:
    """A chunk's symbols end to end, with marks, and the keys of its n-grams."""

    def __init__(self, lengths: list[int], types: bytes, words: bytes, bits: int):
        size = np.array(lengths, np.int64)
        self.known, self.bits = size >= 0, bits
        n = size[self.known]
        self.start, self.sizes = np.cumsum(n + ORDER) - n - ORDER, n + 1  # ORDER - 1 marks before each text, one behind
        self.symbols = np.empty(int((n + ORDER).sum()), np.uint64)
        inside = np.ones(len(self.symbols), bool)
        for j in range(ORDER - 1):
            self.symbols[self.start + j] = _MARKS[j]
            inside[self.start + j] = False
        self.symbols[self.start + n + ORDER - 1] = _MARKS[2]
        inside[self.start + n + ORDER - 1] = False
        self.symbols[inside] = opened(types, np.uint64)[opened(words, np.uint32)]
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n + ORDER)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places where n-grams of k symbols end, and their keys: k in the two high bits, then bits of a hash."""
        x = np.zeros(len(self.symbols), np.uint64)
        for j in range(k):
            x *= np.uint64(0x9E3779B97F4A7C15)
            x[j:] ^= self.symbols[: len(x) - j]
            x = common.mix(x)
        ok = np.ones(len(x), bool)
        for j in range(min(k - 1, len(x))):
            ok[self.start + j] = False
        at = np.flatnonzero(ok).astype(np.int32)
        low = np.uint64(62 - self.bits)
        return at, np.uint64(k) << np.uint64(62) | x[at] >> np.uint64(2) >> low << low


def _requests(chunks: DataFrame, parts: int, bits: int, asks: bool, counts: bool) -> DataFrame:
    """(part, chunk, keys, n, asks): each chunk's distinct n-grams by parts, and how often it has them."""
    low = np.uint64(62 - bits)

    def run(batch):
        r = batch.to_pylist()[0]
        stream, out = Stream(r["lengths"], r["types"], r["words"], bits), {"part": [], "chunk": [], "keys": [], "n": [], "asks": []}
        for k in range(1, ORDER + 1):
            keys = np.sort(stream.grams(k)[1])
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            n = np.diff(np.append(at, len(keys))).astype(np.uint32) if counts else np.zeros(len(at), np.uint32)
            keys = keys[at]
            borders = np.searchsorted(keys, (np.uint64(k) << np.uint64(62)) + np.arange(1, parts, dtype=np.uint64) * np.uint64(2**62 // parts))
            for p, (a, b) in enumerate(zip([0, *borders], [*borders, len(keys)])):
                if a == b:
                    continue
                cells = (k - 1) * parts + p, r["chunk"], squeezed(np.diff(keys[a:b], prepend=np.uint64(0)) >> low), squeezed(n[a:b]), asks
                for c, x in zip(out, cells):
                    out[c].append(x)
        return out

    return common.map_arrow(chunks, run, "part int, chunk bigint, keys binary, n binary, asks boolean", rows=1)


def _answers(requests: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, n, kinds): the corpus' count of each n-gram that the chunk asks for; kinds of words in the part."""

    def add(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(opened(k, np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        n = np.concatenate([opened(x, np.uint32) for x in table.column("n").to_pylist()])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, n, len(distinct)).astype(np.uint64)
        kinds = int((total > 0).sum()) if table.column("part")[0].as_py() < parts else 0
        rows = [i for i, a in enumerate(table.column("asks").to_pylist()) if a]
        ends = np.cumsum([len(k) for k in keys])
        cells = [squeezed(total[at[ends[i] - len(keys[i]) : ends[i]]]) for i in rows]
        found = table.select(["chunk", "part"]).take(pa.array(rows, pa.int64()))
        return found.append_column("n", pa.array(cells, pa.binary())).append_column("kinds", pa.array([kinds] * len(rows), pa.int64()))

    return requests.groupBy("part").applyInArrow(add, "chunk bigint, part int, n binary, kinds bigint")


def log_probabilities(stream: Stream, totals, symbols: int, kinds: int, own: bool) -> np.ndarray:
    """Of each text: the log-probability. totals(k) has the counts of the stream's distinct n-grams by their keys.

    symbols and kinds are the corpus' words and end marks, and how many different ones there are; with own, the texts
    are part of the corpus.
    """

    def counts(k: int) -> np.ndarray:
        """How often the rest of the corpus has the n-gram that ends at each place."""
        at, keys = stream.grams(k)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        del order
        new = np.append(True, keys[1:] != keys[:-1])
        count = np.repeat(totals(k).astype(np.float64), np.diff(np.append(np.flatnonzero(new), len(keys))))
        if own:  # equal n-grams of one text are neighbours too
            doc = stream.doc[at]
            new[1:] |= doc[1:] != doc[:-1]
            runs = np.diff(np.append(np.flatnonzero(new), len(keys)))
            count -= np.repeat(runs, runs)
        out = np.zeros(len(stream.symbols))
        out[at] = count
        return out

    scored_ = np.ones(len(stream.symbols), bool)
    for j in range(ORDER - 1):
        scored_[stream.start + j] = False
    at = np.flatnonzero(scored_)
    other = symbols - np.repeat(stream.sizes, stream.sizes) if own else symbols
    n = counts(1)
    p = (n[at] + PRIOR / (kinds + 1)) / (other + PRIOR)
    for k in range(2, ORDER + 1):  # the state of history h has n(h); without an arc only the failure arc's weight is left
        history, n = n[at - 1], counts(k)
        p = (n[at] + PRIOR * p) / (history + PRIOR)
    return np.add.reduceat(np.log(p), np.cumsum(stream.sizes) - stream.sizes)


def scored(docs: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_symbols, log_prob, perplexity) of each row of docs, by the automaton of corpus.

    Without a corpus docs is the corpus, and each row is scored by all others.
    """
    common.ready(docs.sparkSession)
    own = corpus is None
    chunks = common.written(_chunks(docs), "chunks")
    counted = chunks if own else common.written(_chunks(corpus), "corpus")
    size = F.aggregate(F.filter("lengths", lambda n: n >= 0), F.lit(0).cast("bigint"), lambda s, n: s + n + 1)
    symbols = int(counted.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
    parts, bits = max(1, ceil(symbols / PART_GRAMS)), min(62, key_bits(symbols))
    requests = _requests(counted, parts, bits, own, True)
    requests = requests if own else requests.unionByName(_requests(chunks, parts, bits, True, False))
    answers = common.written(_answers(requests, parts), "answers")
    by_part = answers.groupBy("part").agg(F.max("kinds").alias("kinds")).agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    kinds = max(0, int(by_part) - (ORDER - 1 if symbols else 0))  # start marks are never symbols

    def score(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        r = chunk.to_pylist()[0]
        stream = Stream(r["lengths"], r["types"], r["words"], bits)
        cells = dict(zip(replies.column("part").to_pylist(), replies.column("n").to_pylist()))
        totals = lambda k: np.concatenate([np.zeros(0, np.uint64), *(opened(cells[p], np.uint64) for p in range((k - 1) * parts, k * parts) if p in cells)])
        log, n = np.zeros(len(stream.known)), np.zeros(len(stream.known), np.int64)
        if stream.known.any():
            log[stream.known], n[stream.known] = log_probabilities(stream, totals, symbols, kinds, own), stream.sizes
        none = ~stream.known
        return pa.table({
            "doc_id": pa.array(r["ids"], pa.int64()), "n_symbols": pa.array(n, mask=none), "log_prob": pa.array(np.round(log, 4), mask=none),
            "perplexity": pa.array(np.round(np.exp(-log / np.maximum(n, 1)), 6), mask=none),
        })

    return chunks.groupBy("chunk").cogroup(answers.select("chunk", "part", "n").groupBy("chunk")).applyInArrow(score, "doc_id bigint, n_symbols bigint, log_prob double, perplexity double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.load(spark, sf_dir, "documents", spread=True))
