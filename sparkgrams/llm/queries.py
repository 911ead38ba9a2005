"""The subpackage's registered queries: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_contamination
from .hamming_search import search_codes
from .licenses import scan_licenses
from .near_dedup import link_near_duplicates
from .packing import pack
from .quality import fit_quality, score_quality
from .substring_dedup import cut_repeats
from .token_counts import count_tokens
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import filter_urls

#: The rules of the URL query, as host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
CONTEXT = 2048
#: Fixed value: the score from which a text is predicted to be of the kind.
DECISION = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return linked.select("doc_id", "n_shingles", "component_id", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), size=CONTEXT)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def _fold(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def _judged(scored: DataFrame, held: Column) -> DataFrame:
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), _fold("doc_id", 3) == 1
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), learn=~held, decision=DECISION)
    return _judged(score_toxicity(docs, model), held)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), _fold("doc_id", 4) == 2
    model = fit_quality(docs, table(spark, sf_dir, "labels"), learn=~held, decision=DECISION)
    return _judged(score_quality(docs, model), held)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


def op9_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search_codes(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_near_dedup": op3_near_dedup,
        "op4_packing": op4_packing,
        "op5_url_filter": op5_url_filter,
        "op6_toxicity": op6_toxicity,
        "op7_quality": op7_quality,
        "op8_token_counts": op8_token_counts,
        "op9_hamming_topk": op9_hamming_topk,
        "op10_decontamination": op10_decontamination,
    }
