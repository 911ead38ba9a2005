"""A corpus on disk: words, postings (sorted by gram), words with their ranked
grams, and settings."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..functions import GramConfig, KeyTransformer

RANKS = "text string, n_chars int, size long, tokens array<long>, bits0 long, bits1 long"
COUNTS = "bucket int, df long"


def save_corpus(corpus, path: str) -> None:
    """Postings are dealt by ranges of grams and sorted, so that a search reads
    only the parts of the files that hold its own."""
    spark = corpus.words.sparkSession
    corpus.words.write.mode("overwrite").parquet(f"{path}/words")
    corpus.postings.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/postings")
    ranks = corpus.ranks
    ranks.counts.write.mode("overwrite").parquet(f"{path}/counts")
    ranks.words.write.mode("overwrite").parquet(f"{path}/ranks")
    spark.createDataFrame([(corpus.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_corpus(spark: SparkSession, path: str):
    from ..operators.corpus import POSTINGS, WORDS, Corpus, Ranks

    saved = json.loads(spark.read.text(f"{path}/config").first()[0])
    return Corpus(
        GramConfig.from_dict(saved["config"]),
        KeyTransformer.from_names(saved["transformers"]),
        spark.read.schema(WORDS).parquet(f"{path}/words"),
        spark.read.schema(POSTINGS).parquet(f"{path}/postings"),
        saved["mixed"],
        Ranks(spark.read.schema(RANKS).parquet(f"{path}/ranks"), spark.read.schema(COUNTS).parquet(f"{path}/counts")),
        stored=True,
    )
