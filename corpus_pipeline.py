"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, in the columns of ``documents``, and
gives the same columns; the last gives the pieces of packed sequences with
their token ids.

Defined results: an empty table goes through all stages. Other columns than those
of ``documents`` are dropped, whatever their names. Repeated rows are repeats of one
document: those of an id that the quality or the leak stage rejects all go, and the
others stay together through all stages. Rows that share an id but not a text are
judged by their own texts in the near-duplicate and passage stages. Rows with a null
id can't be named: no stage drops them or takes them for another's copy, and their
passages stay. Null texts are empty ones: they are scored as such, have no
duplicates, passages or leaks, and are packed as their end token alone; other null
columns stay null. Of equal texts the smallest id stays. Texts of any length are
read whole. Without labels of both kinds no quality can be told, and all documents
stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrams.llm.decontaminate import find_contamination
from sparkgrams.llm.near_dedup import drop_near_duplicates
from sparkgrams.llm.packing import pack
from sparkgrams.llm.quality import fit_quality, score_quality
from sparkgrams.llm.queries import CONTEXT, DECISION, table, tokenizer
from sparkgrams.llm.runtime import materialize, release, tables_for, without
from sparkgrams.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage(fn: Callable) -> Callable:
    """A stage's input has been written, so the tables that the stages before
    made on their way are free to go."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "stage")
        with tables_for("stage"):
            return fn(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit_quality(docs, table(spark, sf_dir, "labels"), learn=~held, decision=DECISION)
    if not model.good:
        return docs.select(*COLUMNS)
    rejected = score_quality(docs, model).filter(F.col("score") < DECISION).select("doc_id")
    return without(docs, materialize(rejected, "rejected"), "doc_id").select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    return drop_near_duplicates(docs).select(*COLUMNS)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document of a smaller id are cut out."""
    cut = remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").dropDuplicates()
    return without(docs, materialize(found, "leaks"), "doc_id").select(*COLUMNS)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer("byte_bpe_50k.json"), size=CONTEXT, with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]

#: SQL can't express the classifier or the tokenizer; the tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = materialize(step(spark, docs, sf_dir), name)
    return docs
