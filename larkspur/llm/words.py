"""Word types: numbered while texts are split, and their hashed subword features, computed once per type."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix

MUL = np.uint64(0x100000001B3)
PIECE = 1 << 18


class Types(dict):
    """word -> number, numbered as they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def ids(self, text: str | None) -> np.ndarray:
        words = text.split() if text else ()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def code_blocks(words: list[str]):
    """(rows, code points padded with 0, lengths) by class of length, so that one long word doesn't widen all."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = 8
    done = np.zeros(len(words), bool)
    while not done.all():
        rows = np.flatnonzero(~done & (lengths <= width))
        step = max(1, 2_000_000 // width)
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            # NUL can't be told from the padding, so it counts as the private character U+F8FF
            codes = np.array([words[r].replace("\0", "") for r in part], dtype=f"<U{width}").view(np.uint32).reshape(len(part), width)
            yield part, codes.astype(np.uint64), lengths[part]
        done[rows] = True
        width *= 2


def word_hash(words: list[str], seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word, the same everywhere; one call a word, whatever its length."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.encode("utf-8", "surrogatepass"), seed) for w in words), np.uint64, len(words))


def features(words: list[str], buckets: int, grams: tuple[int, ...], affixes: int = 0, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers below buckets of all words end to end, and how many each word has.

    Of each word: itself, its character n-grams (with a mark at either end) and its prefixes and suffixes of up
    to `affixes` characters, each kind hashed with its own seed. Words of more than PIECE characters are cut into
    pieces that overlap, with the same result, so that work arrays don't grow with the longest word.
    """
    n = len(words)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    if whole:
        parts.append((np.arange(n), word_hash(words, 3) % np.uint64(buckets)))
    short = [i for i, w in enumerate(words) if len(w) <= PIECE]
    for i in range(n) if len(short) < n else ():
        if len(words[i]) > PIECE:
            parts += [(np.full(len(x), i), x) for x in _long_features(words[i], buckets, grams, affixes)]
    at_short = np.array(short, np.int64)
    for rows, codes, lengths in code_blocks([words[i] for i in short] if len(short) < n else words):
        rows = at_short[rows]
        w = codes.shape[1]
        c = np.zeros((len(rows), w + 2), np.uint64)
        c[:, 0] = 2
        c[:, 1 : w + 1] = codes
        c[np.arange(len(rows)), lengths + 1] = 3
        h, ends = np.full(c.shape, 11, np.uint64), lengths + 2
        for k in range(1, max(grams, default=0) + 1):
            m = w + 2 - k + 1
            if m <= 0:
                break
            h = h[:, :m] * MUL + c[:, k - 1 : k - 1 + m]
            if k in grams:
                at = np.nonzero(np.arange(m)[None, :] + k <= ends[:, None])
                parts.append((rows[at[0]], mix(h[at] + np.uint64(k << 32)) % np.uint64(buckets)))
        pre = np.full(len(rows), 5, np.uint64)
        suf = np.full(len(rows), 6, np.uint64)
        for k in range(1, affixes + 1):
            if k > w:
                break
            ok = lengths >= k
            pre = pre * MUL + codes[:, k - 1]
            suf = suf * MUL + codes[np.arange(len(rows)), np.maximum(lengths - k, 0)]
            for kind, x in ((1, pre), (2, suf)):
                parts.append((rows[ok], mix(x[ok] + np.uint64(kind << 40 | k << 32)) % np.uint64(buckets)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    row = np.concatenate([p[0] for p in parts])
    flat = np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(row, kind="stable")
    return flat[order], np.bincount(row, minlength=n)


def _long_features(word: str, buckets: int, grams: tuple[int, ...], affixes: int):
    """The feature numbers of one long word but for the word itself, in pieces."""
    codes = np.frombuffer(word.replace("\0", "\uf8ff").encode("utf-32-le", "surrogatepass"), np.uint32)
    marked = np.concatenate([np.array([2], np.uint32), codes, np.array([3], np.uint32)])
    most = max(grams, default=0)
    for lo in range(0, len(marked), PIECE):
        c = marked[lo : lo + PIECE + most - 1].astype(np.uint64)
        h = np.full(len(c), 11, np.uint64)
        for k in range(1, most + 1):
            m = len(c) - k + 1
            if m <= 0:
                break
            h = h[:m] * MUL + c[k - 1 : k - 1 + m]
            if k in grams:
                yield mix(h[:PIECE] + np.uint64(k << 32)) % np.uint64(buckets)
    pre, suf = np.full(1, 5, np.uint64), np.full(1, 6, np.uint64)
    for k in range(1, affixes + 1):
        pre, suf = pre * MUL + codes[k - 1 : k].astype(np.uint64), suf * MUL + codes[len(codes) - k : len(codes) - k + 1].astype(np.uint64)
        for kind, x in ((1, pre), (2, suf)):
            yield mix(x + np.uint64(kind << 40 | k << 32)) % np.uint64(buckets)


def sums(table: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per word the sum of table's rows at its features."""
    out = np.zeros((len(counts), table.shape[1]), np.float64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[some]
        for c in range(table.shape[1]):  # by column: faster than whole rows at these widths
            out[some, c] = np.add.reduceat(table[flat, c], starts)
    return out


def slices(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The slices flat[offsets[w] : offsets[w + 1]] end to end."""
    n = offsets[which + 1] - offsets[which]
    return flat[np.arange(n.sum()) + np.repeat(offsets[which] - (np.cumsum(n) - n), n)]


class Marks:
    """The distinct values of arrays of small numbers, and where each item is among them, without sorting."""

    def __init__(self, size: int):
        self.seen, self.at = np.zeros(size, bool), np.zeros(size, np.int64)

    def distinct(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.seen[x] = True
        rows = np.flatnonzero(self.seen)
        self.at[rows] = np.arange(len(rows))
        self.seen[rows] = False
        return rows, self.at[x]


class TypeTable:
    """Values per word type, computed when a type first comes and kept for later texts, up to a number of types."""

    def __init__(self, compute, width: int, most: int = 250_000, kind=np.float32):
        self.compute, self.width, self.most, self.kind = compute, width, most, kind
        self.clear()

    def clear(self) -> None:
        self.types, self.values, self.known = Types(), np.zeros((1024, self.width), self.kind), 0

    def groups(self, texts: list[str | None], words: int = 200_000):
        """(first text, last text + 1, type numbers of their words end to end, words per text), of bounded size."""
        lo, ids, total = 0, [], 0
        for i, text in enumerate(texts):
            ids.append(self.types.ids(text))
            total += len(ids[-1])
            if total >= words or i == len(texts) - 1:
                self._learn()
                yield lo, i + 1, np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
                if len(self.types) > self.most:
                    self.clear()
                lo, ids, total = i + 1, [], 0

    def _learn(self) -> None:
        n = len(self.types)
        if n > len(self.values):
            grown = np.zeros((max(n, 2 * len(self.values)), self.width), self.kind)
            grown[: self.known] = self.values[: self.known]
            self.values = grown
        if n > self.known:
            new = list(self.types)[self.known :] if self.known else list(self.types)
            for k in range(0, len(new), 50_000):
                part = new[k : k + 50_000]
                self.values[self.known : self.known + len(part)] = self.compute(part)
                self.known += len(part)
