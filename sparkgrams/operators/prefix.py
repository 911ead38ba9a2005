"""Words as sets of numbered grams in order of rarity, and joins on the rarest.

The k-th occurrence of a gram in a text is a token of its own, so what two texts
share is the intersection of their tokens. With all tokens in one order, texts
that are similar enough share one of their first few (prefix filter); how few
follows from the threshold. Pairs are compared where they meet first, by all their
tokens, which travel with them: nothing is joined again. Most pairs that can't be
similar go before that, by their sizes, by the places where they meet, and by two
words of bits that each text's tokens set: a bit that only one of them has stands
for a token that the other lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import count_grams, ngrams
from ..functions.similarity import all_grams
from ..plans.pruning import enough_shared, few_apart, prefix_length, sizes_fit

#: Counts by which rare tokens are told from common ones: a table of this many
#: rows goes to every task, whatever the number of tokens. Any order that is the
#: same for all texts is right; a count shared by chance only costs candidates.
BUCKETS = 1 << 16


def tokens_of(texts: DataFrame, key: str, padded: str, arity: int) -> DataFrame:
    """``key, n_chars, token, bucket``, a row for each token."""
    grams = texts.select(key, F.length(padded).alias("n_chars"), F.sort_array(ngrams(F.col(padded), arity)).alias("g"))
    numbered = F.transform("g", lambda g, n: F.xxhash64(g, n - F.array_position("g", g)))
    rows = grams.select(key, "n_chars", F.explode(numbered).alias("token"))
    return rows.withColumn("bucket", F.pmod(F.col("token"), F.lit(BUCKETS)).cast("int"))


def counts_of(tokens: DataFrame) -> DataFrame:
    """``bucket, df``: at most ``BUCKETS`` rows."""
    return tokens.groupBy("bucket").agg(F.count("*").alias("df"))


def ranked(tokens: DataFrame, key: str, counts: DataFrame, arity: int) -> DataFrame:
    """``key, n_chars, size, tokens, bits0, bits1``, the rarest token first. Texts
    that lie together by their key are put together where they are."""
    rows = tokens.join(F.broadcast(counts), "bucket", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("token").bitwiseAND(F.lit(63)).cast("int"))
    low = F.col("token").bitwiseAND(F.lit(64)) == 0
    held = rows.groupBy(key, "n_chars").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"),
        F.bit_or(F.when(low, bit).otherwise(F.lit(0).cast("long"))).alias("bits0"),
        F.bit_or(F.when(low, F.lit(0).cast("long")).otherwise(bit)).alias("bits1"),
    )
    return held.select(key, "n_chars", count_grams(F.col("n_chars"), arity).cast("long").alias("size"), F.col("t.token").alias("tokens"), "bits0", "bits1")


def prefixes(texts: DataFrame, key: str, side: str, bound: float, *, smaller: bool = False) -> DataFrame:
    """A row for each of a text's first tokens: ``token`` and, with the side's
    letter, the text, its length, size, tokens, bits and the token's place. Of
    the ``smaller`` of two texts fewer tokens are enough."""
    least = 2 * bound / (1 + bound) if smaller else bound
    first = F.slice("tokens", F.lit(1), prefix_length(F.col("size"), least).cast("int"))
    rows = texts.select(key, "n_chars", "size", "tokens", "bits0", "bits1", F.posexplode(first).alias("at", "token"))
    names = ((key, "text"), ("n_chars", "chars"), ("size", "size"), ("tokens", "tokens"), ("bits0", "bits0"), ("bits1", "bits1"), ("at", "at"))
    return rows.select("token", *[F.col(c).alias(f"{side}_{n}") for c, n in names])


def compare(met: DataFrame, bound: float, arity: int) -> DataFrame:
    """Pairs (sides a and b) that met at a token: those that can reach the bound,
    each once, with ``same`` and ``all``."""
    sizes = (F.col("a_size"), F.col("b_size"))
    # what stands after both places bounds what the two can still share
    rest = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    apart = sum(F.bit_count(F.col(f"a_bits{n}").bitwiseXOR(F.col(f"b_bits{n}"))) for n in (0, 1))
    met = met.filter(sizes_fit(*sizes, bound) & enough_shared(rest, *sizes, bound) & few_apart(apart, *sizes, bound))
    before = F.arrays_overlap(_first("a"), _first("b"))
    # of an array of one: filters on what follows from it would else each intersect anew
    same = F.explode(F.array(F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long")))
    met = met.filter(~before).withColumn("same", same)
    met = met.filter(enough_shared(F.col("same"), *sizes, bound))
    return met.withColumn("all", all_grams(F.col("a_chars"), F.col("b_chars"), F.col("same"), arity))


def _first(side: str) -> Column:
    return F.slice(f"{side}_tokens", F.lit(1), F.col(f"{side}_at"))
