"""Tokens, BM25 terms and typo-tolerant matching as expressions on a row's own text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BUCKET = 8


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits of 3 bytes or more, in order."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda t: F.octet_length(t) >= 3)


def let(value: Column, then) -> Column:
    """then(value) with value computed once, wherever the expression ends up in the plan.

    A projected column isn't enough: when a filter on the result moves down, Catalyst puts the column's whole
    expression in each place that names it.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query, in order."""
    found = re.findall(r"[^\W_]+", query.lower())
    return list(dict.fromkeys(t for t in found if len(t.encode()) >= 3))


def term_count(toks: Column, term: str) -> Column:
    return F.size(F.filter(toks, lambda t: t == term))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n + 0.5 - df) / (0.5 + df))


def bm25_part(tf: Column, length: Column, mean: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def auto_edits(term: str) -> int:
    n = len(term.encode())
    return 0 if n <= 4 else 1 if n <= 8 else 2


def within(t: Column, term: str, edits: int) -> Column:
    return t == term if edits == 0 else F.levenshtein(t, F.lit(term), edits) >= 0


def matches(toks: Column, term: str, edits: int) -> Column:
    return F.exists(toks, lambda t: within(t, term, edits))


def _hit(edits: Column, term: str, most: int):
    """Whether a token stands for the term, at the edits that the row's best match has."""

    def hit(t: Column) -> Column:
        test = F.when(edits == 0, t == term)
        for d in range(1, most + 1):
            test = test.when(edits == d, within(t, term, d))
        return F.coalesce(test, F.lit(False))

    return hit


def _bucket(hit):
    return lambda t, i: F.when(hit(t), F.floor(i / BUCKET))


def _gap(a: Column, b: Column) -> Column:
    """The least distance between two arrays of numbers."""
    return F.array_min(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.abs(x - y)))))


def search_score(fields: list[Column], query: str) -> Column:
    """words * 1e12 + typo * 1e9 + proximity * 1e6 + field order * 1e3 + exactness, of token arrays per field."""
    terms = query_terms(query)
    if not terms:
        return F.lit(0.0)
    empty = F.array().cast("array<string>")
    given = [F.coalesce(f, empty).alias(f"f{i}") for i, f in enumerate(fields)]
    bound = lambda s: let(F.concat(*[s[f"f{i}"] for i in range(len(given))]), lambda every: _cascade([s[f"f{i}"] for i in range(len(given))], every, terms))
    return let(F.struct(*given), bound)


def _cascade(fields: list[Column], every: Column, terms: list[str]) -> Column:
    edits = []
    for term in terms:
        e = F.when(F.array_contains(every, term), 0)
        for d in range(1, auto_edits(term) + 1):
            e = e.when(matches(every, term, d), d)
        edits.append(e)
    # the edits, and then where the hits are, are computed once a row, not once for each token that is held against them
    return let(F.array(*edits), lambda es: _placed(fields, every, terms, [F.get(es, F.lit(i)) for i in range(len(terms))]))


def _placed(fields: list[Column], every: Column, terms: list[str], edits: list[Column]) -> Column:
    buckets, first = [], []
    for term, e in zip(terms, edits):
        hit = _hit(e, term, auto_edits(term))
        buckets.append(F.filter(F.transform(every, _bucket(hit)), lambda x: x.isNotNull()))
        where = F.lit(len(fields))
        for k in range(len(fields) - 1, -1, -1):
            where = F.when(F.exists(fields[k], hit), k).otherwise(where)
        first.append(where)
    found = F.struct(F.array(*buckets).alias("at"), F.array(*first).alias("first"))
    at = lambda s: [F.get(s["at"], F.lit(i)) for i in range(len(terms))]
    return let(found, lambda s: _summed(fields, terms, edits, at(s), F.array_min(s["first"])))


def _summed(fields: list[Column], terms: list[str], edits: list[Column], buckets: list[Column], best: Column) -> Column:
    total = lambda xs: sum(xs[1:], xs[0])
    found = total([F.when(e.isNotNull(), 1).otherwise(0) for e in edits])
    typo = 1 - total([F.coalesce(e, F.lit(0)) for e in edits]) / (found * 2.0)
    near = [F.when((F.size(a) > 0) & (F.size(b) > 0), 1 / (1.0 + _gap(a, b))) for a, b in zip(buckets, buckets[1:])]
    proximity = F.lit(1.0)
    if near:
        pairs = total([F.when(x.isNotNull(), 1).otherwise(0) for x in near])
        proximity = F.when(pairs == 0, 0.5).otherwise(total([F.coalesce(x, F.lit(0.0)) for x in near]) / F.greatest(pairs, F.lit(1)))
    order = F.lit(1.0) if len(fields) < 2 else F.when(best >= len(fields), 1.0).otherwise(1 - best / (len(fields) - 1.0))
    sizes = F.array(*[F.size(f) for f in fields])
    least = F.array_min(F.filter(sizes, lambda n: n > 0))
    exact = F.when(F.array_contains(sizes, len(terms)), 1.0).when(least > len(terms), len(terms) / least).otherwise(0.0)
    return F.when(found == 0, 0.0).otherwise(found / len(terms) * 1e12 + typo * 1e9 + proximity * 1e6 + order * 1e3 + exact)
