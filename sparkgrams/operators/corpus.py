"""The corpus: distinct words and, as an inverted index, their grams."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import GramConfig, KeyTransformer, Pad, count_grams, gram_map, ngrams, pad_text
from ..sources.texts import as_frame
from .prefix import counts_of, ranked, tokens_of

WORDS = "text string, text_padded string, arity int, n_chars int"
POSTINGS = "gram string, text string, n_chars int, cnt int"


@dataclass(frozen=True)
class CorpusBuilder:
    """Settings and texts; the texts are read when the corpus is. Settings count
    as they are at ``finish()``, whatever the order of calls."""

    config: GramConfig = field(default_factory=GramConfig)
    transformer: KeyTransformer = field(default_factory=KeyTransformer)
    texts: DataFrame | None = field(default=None, compare=False)

    def arity(self, arity: int) -> CorpusBuilder:
        return replace(self, config=replace(self.config, arity=arity))

    def pad_left(self, pad: Pad) -> CorpusBuilder:
        return replace(self, config=replace(self.config, pad_left=pad))

    def pad_right(self, pad: Pad) -> CorpusBuilder:
        return replace(self, config=replace(self.config, pad_right=pad))

    def pad_full(self, pad: Pad) -> CorpusBuilder:
        return self.pad_left(pad).pad_right(pad)

    def link_key_transformer(self, step, name: str | None = None) -> CorpusBuilder:
        return replace(self, transformer=self.transformer.link(step, name))

    def case_insensitive(self) -> CorpusBuilder:
        return replace(self, transformer=self.transformer.lower())

    def fill(self, texts: DataFrame | Iterable[str], column: str | None = None, spark: SparkSession | None = None) -> CorpusBuilder:
        """Add a frame's column, or any strings."""
        more = as_frame(texts, column, spark)
        return replace(self, texts=more if self.texts is None else self.texts.unionByName(more))

    fill_par = fill

    def finish(self, spark: SparkSession | None = None) -> Corpus:
        texts = self.texts
        if texts is None:
            texts = as_frame([], None, spark)
        return Corpus(self.config, self.transformer, word_rows(texts.select(self.transformer(F.col("text")).alias("text")), self.config))

    def __repr__(self) -> str:
        return f"CorpusBuilder({self.config}, transformers={self.transformer.names}, texts={self.texts is not None})"


def word_rows(texts: DataFrame, config: GramConfig) -> DataFrame:
    """Distinct non-null texts, padded."""
    distinct = texts.filter("text is not null").dropDuplicates(["text"])
    padded = pad_text(F.col("text"), config)
    return distinct.select("text", padded.alias("text_padded"), F.lit(config.arity).alias("arity"), F.length(padded).alias("n_chars"))


@dataclass(frozen=True)
class Ranks:
    """Words with their numbered grams, the rarest first, and the counts behind
    that order."""

    words: DataFrame
    counts: DataFrame


@dataclass(frozen=True)
class Corpus:
    """Immutable: adding gives a new corpus. ``words`` has one row a text; a
    text without grams is a word too, though no search finds it."""

    config: GramConfig
    transformer: KeyTransformer
    words: DataFrame = field(compare=False)
    index: DataFrame | None = field(default=None, compare=False)
    mixed: bool = False
    ranking: Ranks | None = field(default=None, compare=False)
    #: The index is sorted files, of which a search reads a part.
    stored: bool = field(default=False, compare=False)

    @property
    def postings(self) -> DataFrame:
        """``gram, text, n_chars, cnt``: rows of the words' clustering by text
        are counted where they are, with no second shuffle."""
        if self.index is not None:
            return self.index
        return postings_of(self.words, self.config, self.mixed)

    @property
    def ranks(self) -> Ranks:
        """What searches of many queries and joins work on."""
        if self.ranking is not None:
            return self.ranking
        arity = self.config.arity
        tokens = tokens_of(searchable(self.words, self.config, self.mixed), "text", "text_padded", arity)
        counts = counts_of(tokens)
        return Ranks(ranked(tokens, "text", counts, arity), counts)

    def cache(self) -> Corpus:
        """The same corpus with words, postings and ranks kept by the executors
        once they have been asked for."""
        kept = replace(self, words=self.words.persist(), index=None, ranking=None, stored=False)
        counts = kept.ranks.counts.persist()
        tokens = tokens_of(searchable(kept.words, self.config, self.mixed), "text", "text_padded", self.config.arity)
        ranks = Ranks(ranked(tokens, "text", counts, self.config.arity).persist(), counts)
        return replace(kept, index=kept.postings.persist(), ranking=ranks)

    def unpersist(self) -> None:
        ranks = self.ranking
        for df in (self.words, self.index, *((ranks.words, ranks.counts) if ranks else ())):
            if df is not None:
                df.unpersist()

    def add_text(self, texts: DataFrame | Iterable[str] | str, column: str | None = None) -> Corpus:
        texts = [texts] if isinstance(texts, str) else texts
        more = as_frame(texts, column, self.words.sparkSession).select(self.transformer(F.col("text")).alias("text"))
        return self._with(word_rows(more, self.config), self.mixed)

    def add_ngram(self, grams: DataFrame) -> Corpus:
        """Add pre-built rows (see ``ngram_rows``) as they are: no transformer,
        no padding of this corpus; the later of two rows of one text counts."""
        return self._with(grams.select("text", "text_padded", "arity", "n_chars"), True)

    def _with(self, more: DataFrame, mixed: bool) -> Corpus:
        both = self.words.withColumn("seq", F.lit(0)).unionByName(more.withColumn("seq", F.lit(1)))
        last = both.groupBy("text").agg(F.max(F.struct("seq", "text_padded", "arity", "n_chars")).alias("w"))
        return replace(self, words=last.select("text", "w.text_padded", "w.arity", "w.n_chars"), index=None, ranking=None, stored=False, mixed=mixed)

    def is_empty(self) -> bool:
        return self.words.isEmpty()

    def key(self, text: str) -> str | None:
        """The text as given, if its transformed form is a word."""
        asked = self.words.sparkSession.range(1).select(F.lit(text).alias("query"))
        return text if not self.keys(asked, "query").isEmpty() else None

    def keys(self, queries: DataFrame, column: str) -> DataFrame:
        """The queries, as given, whose transformed form is a word."""
        asked = queries.withColumn("key_text", self.transformer(F.col(column)))
        found = self.words.select(F.col("text").alias("key_text"))
        return asked.join(found, "key_text", "left_semi").drop("key_text")

    def grams(self) -> DataFrame:
        """The words with their gram maps."""
        return self.words.withColumn("grams", _map_by_arity(self))

    def save(self, path: str) -> None:
        from ..sources.store import save_corpus

        save_corpus(self, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        from ..sources.store import load_corpus

        return load_corpus(spark, path)

    def search(self, text: str, threshold: float, limit: int = 10, warp: float = 2.0) -> DataFrame:
        from .search import search

        return search(self, text, threshold, limit, warp)

    def search_with_warp(self, text: str, warp: float, threshold: float, limit: int = 10) -> DataFrame:
        return self.search(text, threshold, limit, warp)

    search_par = search
    search_with_warp_par = search_with_warp

    def to_json(self) -> str:
        return json.dumps({"config": self.config.to_dict(), "transformers": self.transformer.names, "mixed": self.mixed})

    def __repr__(self) -> str:
        return f"Corpus({self.config}, transformers={self.transformer.names}, words={self.words.schema.simpleString()})"


def _map_by_arity(corpus: Corpus):
    return gram_map(F.col("text_padded"), corpus.config.arity)


def searchable(words: DataFrame, config: GramConfig, mixed: bool) -> DataFrame:
    """Of words that pad to one text the first is searched; those of another
    arity can't share a gram."""
    if not mixed:
        return words
    return words.filter(F.col("arity") == config.arity).groupBy("text_padded", "arity", "n_chars").agg(F.min("text").alias("text"))


def postings_of(words: DataFrame, config: GramConfig, mixed: bool) -> DataFrame:
    windows = searchable(words, config, mixed).select("text", "n_chars", F.explode(ngrams(F.col("text_padded"), config.arity)).alias("gram"))
    return windows.groupBy("text", "n_chars", "gram").agg(F.count("*").cast("int").alias("cnt")).select("gram", "text", "n_chars", "cnt")


def ngram_rows(texts: DataFrame, column: str, config: GramConfig) -> DataFrame:
    """Pre-built rows for ``Corpus.add_ngram``."""
    return word_rows(texts.select(F.col(column).alias("text")), config)


def n_grams(chars, config: GramConfig):
    return count_grams(chars, config.arity)
