"""Fast similarity sketching: every coordinate of a sketch is filled, with concentration as of independent ones.

A sketch of t coordinates is filled in rounds. In round i < t every element is hashed to one bin and a value; a bin
keeps its least value from the first round that reached it. Rounds t to 2t - 1 send every element to bin i - t, so
that no bin stays empty. The rounds end when all bins are full: after about one for a set of t ln t elements or
more, and later for smaller ones, so a set costs O(|set| + t log t), not |set| * t. Two sets agree in a coordinate
with a probability of their Jaccard similarity. (Dahlgaard, Knudsen and Thorup, 2017.)
"""

from __future__ import annotations

import numpy as np

from .common import mix

EMPTY = np.uint64(2**64 - 1)
VALUE_BITS = np.uint64(48)


def fast_sketches(items: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """(sets x t) of sets of 64-bit hashes laid end to end; repeats don't matter, empty sets have EMPTY everywhere."""
    out = np.full(len(counts) * t, EMPTY)
    owner = np.repeat(np.arange(len(counts)), counts)
    mask = (np.uint64(1) << VALUE_BITS) - np.uint64(1)
    full = counts == 0
    for i in range(2 * t):
        if not len(items):
            break
        x = mix(items ^ mix(np.array([i + 1], np.uint64)))
        bins = ((x >> VALUE_BITS) * np.uint64(t) >> np.uint64(16)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, x & mask | np.uint64(i) << VALUE_BITS)
        left = np.flatnonzero(~full)
        done = left[(out.reshape(-1, t)[left] != EMPTY).all(1)]
        if len(done):
            full[done] = True
            keep = ~full[owner]
            items, owner = items[keep], owner[keep]
    return out.reshape(-1, t)


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """(sets x t / rows) bucket hashes; the band's number is part of the hash."""
    parts = sketches.reshape(len(sketches), -1, rows)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64)[None], parts.shape[:2]).copy()
    for j in range(rows):
        h = mix(h * np.uint64(0x100000001B3) ^ parts[:, :, j])
    return h.view(np.int64)
