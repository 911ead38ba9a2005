"""Comparison of given pairs of texts: a narrow plan without shuffle.

The k-th occurrence of a gram in a text is a token of its own, so what two texts
share is the intersection of their tokens. It is taken once for each pair: out of
an array of one, since filters on what follows from it would else each intersect
anew, and wherever the optimizer pushes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import GramConfig, all_grams, diff_grams, matches, ngrams, pad_text, similarity


def compare_pairs(pairs: DataFrame, a: str, b: str, config: GramConfig, warp: float | None = None) -> DataFrame:
    """Adds ``same, all, diff`` and, with a warp, ``similarity`` (double)."""
    padded = {c: pad_text(F.col(c), config) for c in (a, b)}
    grams = {f"sorted_grams_{i}": F.sort_array(ngrams(padded[c], config.arity)) for i, c in enumerate((a, b))}
    same = F.array_size(F.array_intersect(*[_tokens(c) for c in grams])).cast("long")
    out = pairs.withColumns(grams).withColumn("same", F.explode(F.array(same))).drop(*grams)
    out = out.withColumn("all", all_grams(F.length(padded[a]), F.length(padded[b]), F.col("same"), config.arity))
    out = out.withColumn("diff", diff_grams(F.col("same"), F.col("all")))
    return out if warp is None else out.withColumn("similarity", similarity(F.col("same"), F.col("all"), warp))


def match_pairs(pairs: DataFrame, a: str, b: str, config: GramConfig, threshold: float, warp: float = 2.0) -> DataFrame:
    """The pairs that reach the threshold; at a threshold of 0 or less those
    that share nothing too."""
    compared = compare_pairs(pairs, a, b, config, warp)
    return compared.filter(matches(F.col("similarity"), threshold)).select(a, b, "similarity")


def _tokens(grams: str) -> Column:
    """Of a column of sorted grams, each with the number of its occurrence."""
    return F.transform(grams, lambda g, n: F.concat((n - F.array_position(grams, g)).cast("string"), F.lit(":"), g))
