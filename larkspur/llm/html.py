"""HTML extraction with a suffix array per host, in chunks that are merged.

A page's visible text is its tokens outside tags, comments, scripts and styles, with entities decoded. The pages that
a task reads form chunks of about CHUNK_WORDS tokens. A chunk's token streams are laid end to end, with a separator of
its own after each, and their suffixes are sorted by their first MIN_RUN tokens (prefix doubling over tokens that are
told apart by host): a suffix array, in which equal prefixes stand in one run. Each run of a chunk is then merged with
those of all other chunks: its host and tokens as a hash, with whether one page or several have it, goes to a part by
ranges of the hash, and the part answers whether two distinct pages of the corpus have it. That goes in two rounds: in
the first hashes are short (SHORT_BITS more bits than the number of suffixes has), and only what is then shared by
truth or chance is asked again with long ones (SPARE_BITS more). So a host of any size is
spread over as many tasks as its pages, no task holds a host, and no page crosses the network.

Every repeated substring of MIN_RUN tokens or more is covered by such suffixes, so marking MIN_RUN tokens from each
finds exactly all of them. Covered tokens are boilerplate and go; the runs between them stay. Within a chunk tokens are
compared, across chunks long hashes.

Defined results: pages of one host with equal token streams are one page, so a copy doesn't empty its original, and
repeated rows all get the same text. NULL and empty html have the text ''. A NULL or broken url belongs to
the host ''. Rows without a page_id are pages like others. Very long pages are taken whole, in a chunk of their own if
need be. An empty table gives no rows. Other columns, of any names, are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from math import ceil

import numpy as np
import pyarrow as pa
import pyspark
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import key_bits, opened, squeezed
from .words import Types, word_hash

MIN_RUN = 8
CHUNK_WORDS = 1_500_000
PART_KEYS = 2_000_000
SHORT_BITS = 8
SCHEMA = "page_id bigint, host string, text string, n_tokens int, n_removed int"
CHUNK = "chunk bigint, ids array<bigint>, hosts array<string>, contents array<binary>, tokens bigint, sizes array<int>, types binary, words binary"

_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z!?][^\s>/]*)[^>]*>")
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u", "wbr"}
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def visible(html: str | None) -> str:
    """The tokens of a page's visible text, with one blank between them."""
    if not html:
        return ""
    # a tag that the page leaves open ends with it; the mark also keeps the search for its end from running on and on
    bare = _TAG.sub(lambda m: "" if m[2].lower() in _INLINE else " ", _GONE.sub(" ", html + "\0>"))
    return " ".join(unescape(bare.removesuffix("\0>")).split())


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` tokens, and where in it each distinct prefix starts.

    Prefix doubling: the rank by k tokens of a suffix and of the one k tokens on give its rank by 2k.
    """
    n = len(ids)

    def arranged(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k == 1:
            key = ids.astype(np.int64)
        else:
            half = (k + 1) // 2
            order, first = arranged(half)
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(first, dtype=np.int32)
            key = rank.astype(np.int64)
            key *= n + 1
            rest = max(0, n - k + half)
            key[:rest] += rank[n - rest :]
        order = np.argsort(key)
        key = key[order]
        return order, np.append(True, key[1:] != key[:-1])

    order, first = arranged(depth)
    return order, np.flatnonzero(first)


def _chunks(pages: DataFrame) -> DataFrame:
    """Pages in chunks: ids, hosts, digests of the visible texts, and their tokens' numbers, most frequent first."""

    def row(number, ids, hosts, texts, tokens):
        contents, types = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts], Types()
        streams = [types.ids(t) for t in texts]
        flat = np.concatenate(streams)
        by_use = np.argsort(-np.bincount(flat, minlength=len(types)), kind="stable")
        rank = np.empty(len(types), np.uint32)
        rank[by_use] = np.arange(len(types), dtype=np.uint32)
        names = list(types)
        cells = number, ids, hosts, contents, tokens, [len(s) for s in streams], _packed([names[i] for i in by_use.tolist()]), squeezed(rank[flat])
        return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(cells, arrow)], schema=arrow)

    def run(batches):
        number, ids, hosts, texts, tokens = pyspark.TaskContext.get().partitionId() << 20, [], [], [], 0
        for batch in batches:
            for i, host, html in zip(*(batch.column(c).to_pylist() for c in range(3))):
                text = visible(html)
                n = text.count(" ") + 1 if text else 0
                if ids and tokens + n > CHUNK_WORDS:
                    yield row(number, ids, hosts, texts, tokens)
                    number, ids, hosts, texts, tokens = number + 1, [], [], [], 0
                ids.append(i)
                hosts.append(host)
                texts.append(text)
                tokens += n
        if ids:
            yield row(number, ids, hosts, texts, tokens)

    arrow = common.arrow_schema(CHUNK)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), _host().alias("host"), "html").mapInArrow(run, CHUNK)


_CODEC = pa.Codec("zstd", compression_level=6)


def _packed(texts: list[str]) -> bytes:
    joined = "\n".join(texts).encode("utf-8", "surrogatepass")
    return len(joined).to_bytes(8, "little") + _CODEC.compress(joined, asbytes=True)


def _texts(cell: bytes) -> list[str]:
    return _CODEC.decompress(cell[8:], int.from_bytes(cell[:8], "little"), asbytes=True).decode("utf-8", "surrogatepass").split("\n")


class Suffixes:
    """A chunk's suffix array: runs of suffixes of equal first tokens, and a key for each run that has whole prefixes."""

    def __init__(self, row: dict, min_run: int, bits: int):
        self.sizes, self.words = np.array(row["sizes"], np.int64), opened(row["words"], np.uint32)
        self.types = _texts(row["types"]) if len(self.words) else []
        names, host = np.unique(row["hosts"], return_inverse=True)
        own = self.words.astype(np.int64) * len(names) + np.repeat(host, self.sizes)
        _, own = np.unique(own, return_inverse=True)
        top = int(own.max()) + 1 if len(own) else 0
        begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        ids = np.empty(int((self.sizes + 1).sum()), np.int32)
        inside = np.ones(len(ids), bool)
        inside[begin + self.sizes] = False
        ids[inside] = own
        ids[~inside] = top + np.arange(len(self.sizes))
        self.begin, self.length, self.min_run = begin, len(ids), min_run
        page = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        whole = np.arange(len(ids)) - begin[page] + min_run <= self.sizes[page]  # prefixes that end within the page
        order, start = suffix_array(ids, min_run)
        ok = whole[order[start]]
        counts = np.diff(np.append(start, len(order)))
        order, counts = order[np.repeat(ok, counts)], counts[ok]
        # keys of the runs' prefixes: host, then each token
        hashes = np.zeros(len(ids), np.uint64)
        hashes[inside] = word_hash(self.types)[self.words] if self.types else 0
        first = order[np.cumsum(counts) - counts]
        x = word_hash([str(n) for n in names], 77)[host[page[first]]] if len(first) else np.zeros(0, np.uint64)
        for j in range(min_run):
            x = common.mix(x * np.uint64(0x9E3779B97F4A7C15) ^ hashes[first + j])
        low = np.uint64(64 - bits)
        self.keys = x >> low << low
        self.order, self.counts, self.page = order, counts, page

    def pages(self, muted: list[int]) -> np.ndarray:
        """0, 1 or 2 (or more): how many distinct pages have each run; muted pages are copies of others."""
        page = self.page[self.order]
        start = np.cumsum(self.counts) - self.counts
        live = np.ones(len(self.sizes), bool)
        live[muted] = False
        least = np.where(live[page], page, np.iinfo(np.int64).max)
        most = np.where(live[page], page, -1)
        if not len(start):
            return np.zeros(0, np.uint8)
        lo, hi = np.minimum.reduceat(least, start), np.maximum.reduceat(most, start)
        return np.where(hi < 0, 0, np.where(lo == hi, 1, 2)).astype(np.uint8)

    def asked(self, n: np.ndarray, bits: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some runs: their distinct keys of so many bits, the pages of each (2 for more), and each run's place there."""
        low = np.uint64(64 - bits)
        keys, at = np.unique(self.keys[among] >> low << low, return_inverse=True)
        return keys, np.minimum(np.bincount(at, n[among], len(keys)), 2).astype(np.uint8), at

    def told(self, bits: int, among: np.ndarray, answers: list) -> np.ndarray:
        """Which of some runs are shared, by the parts' answers."""
        out = np.zeros(len(self.keys), bool)
        if among.any():
            _, _, at = self.asked(np.zeros(len(self.keys)), bits, among)
            out[among] = np.concatenate([np.unpackbits(opened(a["shared"], np.uint8), count=a["size"]) for a in answers]).astype(bool)[at]
        return out

    def kept(self, shared: np.ndarray) -> tuple[list[str], list[int]]:
        """Each page's text without the runs that are shared, and how many tokens went."""
        hits = self.order[np.repeat(shared, self.counts)]
        marked = np.zeros(self.length + self.min_run, bool)
        for j in range(self.min_run):
            marked[hits + j] = True
        names, texts, gone, lo = np.array([*self.types, ""], object), [], [], 0
        for b, n in zip(self.begin.tolist(), self.sizes.tolist()):
            stay = ~marked[b : b + n]
            texts.append(" ".join(names[self.words[lo : lo + n][stay]].tolist()))
            gone.append(n - int(stay.sum()))
            lo += n
        return texts, gone


def _copies(chunks: DataFrame) -> DataFrame:
    """(chunk, muted): the places of pages whose host and text an earlier page has."""
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("hosts", "contents")).alias("place", "p")).select("chunk", "place", F.col("p.hosts").alias("host"), F.col("p.contents").alias("content"))
    first = each.groupBy("host", "content").agg(F.min(F.struct("chunk", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = each.join(first, ["host", "content"]).filter("chunk <> first.chunk or place <> first.place")
    return again.groupBy("chunk").agg(F.collect_list("place").alias("muted"))


def extracted(pages: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(page_id, host, text, n_tokens, n_removed) of each page; text is what is left, n_tokens counts before."""
    common.ready(pages.sparkSession)
    chunks = common.written_by(_chunks(pages), "chunks", "chunk")
    tokens = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    parts = max(1, ceil(tokens / PART_KEYS))
    short, long = min(64, key_bits(tokens) - common.SPARE_BITS + SHORT_BITS), key_bits(tokens)

    def ask(bits: int, first: bool):
        def run(batch):
            out = {"part": [], "chunk": [], "keys": [], "n": []}
            for r in batch.to_pylist():
                s = Suffixes(r, min_run, long)
                among = np.ones(len(s.keys), bool) if first else s.told(short, np.ones(len(s.keys), bool), r["answers"])
                keys, n, _ = s.asked(s.pages(r["muted"] or []), bits, among)
                borders = np.searchsorted(keys, np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts)) if parts > 1 else []
                for p, (a, b) in enumerate(zip([0, *borders], [*borders, len(keys)])):
                    if a < b:
                        for c, x in zip(out, (p, r["chunk"], squeezed(np.diff(keys[a:b], prepend=np.uint64(0)) >> np.uint64(64 - bits)), squeezed(n[a:b]))):
                            out[c].append(x)
            return out

        return run

    def merge(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(opened(k, np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        n = np.concatenate([opened(x, np.uint8) for x in table.column("n").to_pylist()])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        shared = (np.bincount(at, n) > 1)[at]
        ends = np.cumsum([len(k) for k in keys])
        cells = [squeezed(np.packbits(shared[e - len(k) : e])) for k, e in zip(keys, ends)]
        sizes = pa.array([len(k) for k in keys], pa.int32())
        return table.select(["chunk", "part"]).append_column("size", sizes).append_column("shared", pa.array(cells, pa.binary()))

    def answered(df: DataFrame, bits: int, first: bool) -> DataFrame:
        asked = common.map_arrow(df, ask(bits, first), "part int, chunk bigint, keys binary, n binary", rows=1)
        told = asked.groupBy("part").applyInArrow(merge, "chunk bigint, part int, size int, shared binary")
        told = told.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "size", "shared"))).alias("answers"))
        return common.written(told, "answers")

    # chunks stay where they are: what they are joined with goes to them
    slim = chunks.select("chunk", "hosts", "sizes", "types", "words")
    rows = common.joined_by(slim, common.written(_copies(chunks), "muted"), "chunk")
    once = answered(rows, short, True)
    twice = answered(common.joined_by(rows, once, "chunk"), long, False).withColumnRenamed("answers", "again")

    def cut(batch):
        out = {f.name: [] for f in arrow}
        for r in batch.to_pylist():
            s = Suffixes(r, min_run, long)
            maybe = s.told(short, np.ones(len(s.keys), bool), r["answers"])
            texts, gone = s.kept(s.told(long, maybe, r["again"]))
            for c, x in zip(out, (r["ids"], r["hosts"], texts, s.sizes.tolist(), gone)):
                out[c] += x
        return out

    arrow = common.arrow_schema(SCHEMA)
    whole = common.joined_by(common.joined_by(chunks.drop("contents"), once, "chunk"), twice, "chunk")
    return common.map_arrow(whole.select("chunk", "ids", "hosts", "sizes", "types", "words", "answers", "again"), cut, SCHEMA, rows=1)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.load(spark, sf_dir, "pages"))
