"""BM25 and typo-tolerant search over a column, with a stored index (postings.py) or without.

Without one, what a query needs to know of the corpus is a few numbers per query term, which one aggregation over the text column
gives; scores are then an expression on each row's own text. So a search is two scans and no shuffle of documents,
and the one row of statistics is all that is broadcast, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def bm25_scored(df: DataFrame, column: str, query: str, name: str, corpus: DataFrame | None = None, postings=None, key: str = "_key") -> DataFrame:
    """df with its BM25 score (k1 = 1.2, b = 0.75) in `name`; 0 for rows that don't match.

    The corpus is every row with text, of `corpus` if given, else of df; or the rows that the postings were built from.
    """
    terms = T.query_terms(query)
    if not terms:
        return df.withColumn(name, F.lit(0.0))
    if postings is not None:
        scores = postings.bm25(terms).select(F.col("key").alias(f"_key_{name}"), F.col("score").alias(name))
        return df.join(scores, F.col(f"`{key}`") == F.col(f"_key_{name}"), "left").drop(f"_key_{name}").withColumn(name, F.coalesce(name, F.lit(0.0)))
    source = corpus if corpus is not None else df
    toks = source.filter(F.col(column).isNotNull()).select(T.tokens(F.col(column)).alias("t"))
    stats = toks.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"), *[F.count_if(F.array_contains("t", t)).alias(f"df{i}") for i, t in enumerate(terms)])
    stats = stats.select(F.struct("*").alias(f"_stats_{name}"))
    s = lambda f: F.col(f"_stats_{name}.{f}")

    def score(t: Column) -> Column:
        n = F.size(t).cast("double")
        parts = [T.bm25_part(T.term_count(t, term).cast("double"), n, s("mean"), T.idf(s("n"), s(f"df{i}"))) for i, term in enumerate(terms)]
        return F.when(F.size(t) > 0, sum(parts[1:], parts[0])).otherwise(0.0)

    rows = df.crossJoin(F.broadcast(stats)).withColumn(name, F.coalesce(T.let(T.tokens(F.col(column)), score), F.lit(0.0)))
    return rows.drop(f"_stats_{name}")


def bm25_search(df: DataFrame, column: str, query: str, k: int, key: str = "_key", postings=None) -> DataFrame:
    """The best k rows that match, with `score`; equal scores by key."""
    return bm25_scored(df, column, query, "score", postings=postings, key=key).filter("score > 0").orderBy(F.desc("score"), key).limit(k)


def bm25_norm(score: Column, k: float = 1.0) -> Column:
    """Into [0, 1)."""
    return F.when(score > 0, score / (score + k)).otherwise(0.0)


def search_matched(df: DataFrame, columns: list[str], query: str, name: str, typo: int | None = None, corpus: DataFrame | None = None, postings=None, key: str = "_key") -> DataFrame:
    """df with `name`: whether all distinct terms of the query are in the row's fields.

    A term that the corpus has counts only exactly; another one within some edits (0 up to 4 bytes, 1 up to 8, else
    2, or `typo`).
    """
    terms = T.query_terms(query)
    if not terms:
        return df.withColumn(name, F.lit(False))
    if postings is not None:
        hits = postings.matching(terms, [T.auto_edits(t) if typo is None else typo for t in terms]).select(F.col("key").alias(f"_key_{name}"), F.lit(True).alias(name))
        return df.join(hits, F.col(f"`{key}`") == F.col(f"_key_{name}"), "left").drop(f"_key_{name}").withColumn(name, F.coalesce(name, F.lit(False)))
    every = lambda: F.flatten(F.array(*[F.coalesce(T.tokens(F.col(c)), F.array().cast("array<string>")) for c in columns]))
    source = corpus if corpus is not None else df
    known = source.select(every().alias("t")).agg(*[F.coalesce(F.bool_or(F.array_contains("t", t)), F.lit(False)).alias(f"k{i}") for i, t in enumerate(terms)]).select(F.struct("*").alias(f"_known_{name}"))

    def hit(t: Column) -> Column:
        test = F.lit(True)
        for i, term in enumerate(terms):
            edits = T.auto_edits(term) if typo is None else typo
            fuzzy = T.matches(t, term, edits) if edits else F.lit(False)
            test = test & F.when(F.col(f"_known_{name}.k{i}"), F.array_contains(t, term)).otherwise(fuzzy)
        return test

    return df.crossJoin(F.broadcast(known)).withColumn(name, T.let(every(), hit)).drop(f"_known_{name}")


def search_scored(df: DataFrame, columns: list[str], query: str, name: str) -> DataFrame:
    """df with the search's cascade score in `name`; it only looks at each row."""
    return df.withColumn(name, T.search_score([T.tokens(F.col(c)) for c in columns], query))


def trigrams(c: Column) -> Column:
    """The distinct lower-case trigrams of a text."""
    low = F.lower(c)
    n = F.char_length(low)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
