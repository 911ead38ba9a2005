"""Texts as one-column frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_frame(texts: DataFrame | Iterable[str], column: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """A column ``text`` of a frame's column (its only one by default), or of
    strings."""
    if isinstance(texts, DataFrame):
        return texts.select(F.col(column or texts.columns[0]).alias("text"))
    session = spark or SparkSession.active()
    return session.createDataFrame([(t,) for t in texts], "text string")


def words_of(df: DataFrame, column: str) -> DataFrame:
    """Distinct white-space separated words of a text column, as ``text``."""
    return df.select(F.explode(F.split(column, r"\s+")).alias("text")).filter("text <> ''").distinct()
