"""Character n-grams of text columns, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import GramConfig


def pad_text(text: Column, config: GramConfig) -> Column:
    return F.concat(F.lit(config.left), text, F.lit(config.right))


def char_count(text: Column) -> Column:
    """Unicode code points."""
    return F.length(text)


def ngrams(padded: Column, arity: int) -> Column:
    """All windows of ``arity`` characters, in order, repeats included; none for
    a shorter text. A look-ahead gives overlapping windows in linear time; its
    first character must not be the second half of a surrogate pair."""
    pattern = r"(?s)(?=([^\x{DC00}-\x{DFFF}].{%d}))" % (max(1, arity) - 1)
    return F.regexp_extract_all(padded, F.lit(pattern), F.lit(1))


def gram_map(padded: Column, arity: int) -> Column:
    """Gram -> count as a map. Counting is by run lengths in the sorted grams;
    fit for words and short texts (exploded rows are for long ones)."""
    runs = F.aggregate(
        F.array_sort(ngrams(padded, arity)),
        F.array().cast("array<struct<g:string,n:int>>"),
        lambda acc, g: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["g"] == g),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(g.alias("g"), (F.try_element_at(acc, F.lit(-1))["n"] + 1).alias("n"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(g.alias("g"), F.lit(1).alias("n"))))),
    )
    return F.map_from_entries(runs)


def count_gram(grams: Column, gram: Column | str) -> Column:
    """How often a gram occurs, 0 if it doesn't."""
    return F.coalesce(F.try_element_at(grams, gram if isinstance(gram, Column) else F.lit(gram)), F.lit(0))


def contains(grams: Column, gram: Column | str) -> Column:
    return F.map_contains_key(grams, gram)


def count_grams(n_chars: Column, arity: int) -> Column:
    """How many grams, repeats included, a padded text of so many characters has."""
    return F.greatest(n_chars - (max(1, arity) - 1), F.lit(0))


def is_empty(n_chars: Column, arity: int) -> Column:
    return n_chars < max(1, arity)


def explode_grams(df: DataFrame, text_col: str, config: GramConfig) -> DataFrame:
    """``text, gram, cnt`` for each distinct non-null text and gram."""
    texts = df.select(F.col(text_col).alias("text")).filter("text is not null").dropDuplicates(["text"])
    windows = texts.select("text", F.explode(ngrams(pad_text(F.col("text"), config), config.arity)).alias("gram"))
    return windows.groupBy("text", "gram").agg(F.count("*").cast("int").alias("cnt"))
