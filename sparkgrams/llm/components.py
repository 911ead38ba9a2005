"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``id, comp`` for every id of the links (columns a, b): the smallest id
    that can be reached.

    Each step takes the smallest label among an id's neighbours, then that
    label's own label, so that chains shorten by half. Labels are written to a
    table after each step; the driver sees only how many changed.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp"))
    labels = materialize(labels, "labels")
    while True:
        told = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("m"))
        lower = labels.join(told, labels["id"] == told["a"]).select("id", F.least("comp", "m").alias("low"), F.col("comp").alias("old"))
        heads = labels.select(F.col("id").alias("low"), F.col("comp").alias("head"))
        step = lower.join(heads, "low", "left").select("id", F.least("low", "head").alias("comp"), "old")
        step = materialize(step, "labels")
        labels = step.select("id", "comp")
        if step.filter("comp <> old").isEmpty():
            return labels
