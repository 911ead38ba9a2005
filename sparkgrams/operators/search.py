"""Threshold searches and similarity joins over a corpus."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import count_grams, matches, ngrams, pad_text, similarity
from ..functions.similarity import all_grams
from ..plans.pruning import jaccard_bound, sizes_fit
from .blocks import all_pairs
from .corpus import Corpus, searchable
from .prefix import compare, prefixes, ranked, tokens_of

#: Rows of queries up to which their grams are broadcast.
BROADCAST_QUERIES = 10_000


def _query_grams(corpus: Corpus, queries: DataFrame, column: str, id_cols: list[str]) -> DataFrame:
    padded = pad_text(corpus.transformer(F.col(column)), corpus.config)
    rows = queries.select(*id_cols, padded.alias("p")).filter("p is not null")
    rows = rows.select(*id_cols, F.length("p").alias("q_chars"), F.explode(ngrams(F.col("p"), corpus.config.arity)).alias("gram"))
    return rows.groupBy(*id_cols, "q_chars", "gram").agg(F.count("*").cast("int").alias("q_cnt"))


def score(corpus: Corpus, queries: DataFrame, column: str, id_cols: list[str], threshold: float, warp: float, *, small: bool) -> DataFrame:
    """``id_cols, text, same, all, similarity`` (double) of every word that
    shares a gram with a query and reaches the threshold: an equi-join on grams,
    a sum, a filter. Words whose length alone rules them out don't reach the
    sum."""
    postings = corpus.postings
    asked = _query_grams(corpus, queries, column, id_cols)
    if small:
        asked = F.broadcast(asked)
    arity, bound = corpus.config.arity, jaccard_bound(threshold, warp)
    met = postings.join(asked, "gram")
    if bound > 0:
        met = met.filter(sizes_fit(count_grams(F.col("n_chars"), arity), count_grams(F.col("q_chars"), arity), bound))
    summed = met.groupBy(*id_cols, "text", "q_chars", "n_chars").agg(F.sum(F.least("cnt", "q_cnt")).cast("long").alias("same"))
    scored = summed.withColumn("all", all_grams(F.col("q_chars"), F.col("n_chars"), F.col("same"), arity))
    scored = scored.withColumn("similarity", similarity(F.col("same"), F.col("all"), warp))
    if math.isnan(warp):
        return scored.select(*id_cols, "text", "same", "all", "similarity").limit(0)
    return scored.filter(matches(F.col("similarity"), threshold)).select(*id_cols, "text", "same", "all", "similarity")


def search(corpus: Corpus, text: str, threshold: float, limit: int = 10, warp: float = 2.0, *, double: bool = False) -> DataFrame:
    """``text, similarity`` of the best ``limit`` words, best first, equal ones
    by text. The similarity is a 32-bit float unless ``double``."""
    query = corpus.words.sparkSession.range(1).select(F.lit(text).alias("query"))
    if corpus.stored:  # only the files' parts that hold one of the query's grams are read
        grams = [r.gram for r in _query_grams(corpus, query, "query", []).select("gram").collect()]
        corpus = replace(corpus, index=corpus.postings.filter(F.col("gram").isin(grams)), stored=False)
    found = score(corpus, query, "query", [], threshold, warp, small=True)
    kept = F.col("similarity") if double else F.col("similarity").cast("float").alias("similarity")
    return found.select("text", kept).orderBy(F.desc("similarity"), "text").limit(max(0, limit))


def search_batch(corpus: Corpus, queries: DataFrame, column: str, threshold: float, limit: int = 10, warp: float = 2.0, *, n_queries: int | None = None) -> DataFrame:
    """``query, rank, text, similarity`` (double) for each distinct query.

    Queries meet the words at their rarest grams, as many as the threshold needs;
    at a threshold of 0 or less, at all. Queries are broadcast where there are
    few; unless ``n_queries`` tells their number, they are counted first.
    """
    asked = queries.select(F.col(column).alias("query")).filter("query is not null").dropDuplicates()
    if n_queries is None:
        n_queries = asked.limit(BROADCAST_QUERIES + 1).count()
    small = n_queries <= BROADCAST_QUERIES
    bound = jaccard_bound(threshold, warp)
    if bound <= 0 or math.isnan(warp):
        found = score(corpus, asked, "query", ["query"], threshold, warp, small=small)
    else:
        arity, ranks = corpus.config.arity, corpus.ranks
        padded = asked.withColumn("padded", pad_text(corpus.transformer(F.col("query")), corpus.config)).filter("padded is not null")
        left = prefixes(ranked(tokens_of(padded, "query", "padded", arity), "query", ranks.counts, arity), "query", "a", bound)
        right = prefixes(ranks.words, "text", "b", bound)
        met = right.join(F.broadcast(left) if small else left, "token")
        found = compare(met, bound, arity).withColumn("similarity", similarity(F.col("same"), F.col("all"), warp))
        found = found.filter(matches(F.col("similarity"), threshold)).select(F.col("a_text").alias("query"), F.col("b_text").alias("text"), "similarity")
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "text")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).select("query", "rank", "text", "similarity")


def similarity_join(corpus: Corpus, threshold: float, warp: float = 2.0, *, strategy: str = "prefix") -> DataFrame:
    """``a, b, same, all, similarity`` (double) of all pairs of words with
    ``a < b`` that reach the threshold (and share a gram).

    ``prefix`` joins on each word's rarest grams only, as many as the threshold
    needs; ``index`` on all; ``blocks`` compares all pairs by bits, for texts that
    are all alike.
    """
    arity, bound = corpus.config.arity, jaccard_bound(threshold, warp)
    if strategy == "blocks":
        pairs = all_pairs(searchable(corpus.words, corpus.config, corpus.mixed), arity, bound)
    elif strategy == "index" or bound <= 0:
        left = corpus.postings.select("gram", F.col("text").alias("a"), F.col("n_chars").alias("a_chars"), F.col("cnt").alias("a_cnt"))
        right = corpus.postings.select("gram", F.col("text").alias("b"), F.col("n_chars").alias("b_chars"), F.col("cnt").alias("b_cnt"))
        pairs = left.join(right, "gram").filter("a < b").groupBy("a", "b", "a_chars", "b_chars").agg(F.sum(F.least("a_cnt", "b_cnt")).cast("long").alias("same"))
        pairs = pairs.withColumn("all", all_grams(F.col("a_chars"), F.col("b_chars"), F.col("same"), arity))
    else:
        words = corpus.ranks.words
        met = prefixes(words, "text", "a", bound, smaller=True).join(prefixes(words, "text", "b", bound), "token")
        met = met.filter("a_size < b_size or (a_size = b_size and a_text < b_text)")
        pairs = compare(met, bound, arity).select(F.least("a_text", "b_text").alias("a"), F.greatest("a_text", "b_text").alias("b"), "same", "all")
    scored = pairs.withColumn("similarity", similarity(F.col("same"), F.col("all"), warp))
    return scored.filter(matches(F.col("similarity"), threshold)).select("a", "b", "same", "all", "similarity")
