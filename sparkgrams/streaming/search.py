"""Streams of queries against a corpus, and streams of words into one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import Corpus, search_batch
from ..sources.shared import folders


def search_stream(corpus: Corpus, queries: DataFrame, column: str, sink: Callable[[DataFrame, int], None], threshold: float, limit: int = 10, warp: float = 2.0, *, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Answer each micro-batch of queries; ``sink(frame, batch)`` stores it."""

    def answer(batch: DataFrame, number: int) -> None:
        sink(search_batch(corpus, batch, column, threshold, limit, warp), number)

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def generations(spark: SparkSession, path: str) -> list[int]:
    """The complete generations at a path, in order: the settings of a corpus
    are written last."""
    found = (int(name) for name in folders(spark, path) if name.isdigit())
    return sorted(n for n in found if "config" in folders(spark, f"{path}/{n}"))


def append_stream(texts: DataFrame, column: str, path: str, corpus: Corpus, *, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Add each micro-batch of texts to the corpus saved at ``path``: every batch
    becomes a generation ``path/<number>``, which starts from the one before; only
    the first starts from ``corpus``. Nothing is kept by the driver, so a stream
    that is started again from its checkpoint goes on where it stopped; a replayed
    batch rewrites its own generation."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in generations(spark, path) if n < number]
        start = Corpus.load(spark, f"{path}/{before[-1]}") if before else corpus
        start.add_text(batch, column).save(f"{path}/{number}")

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
