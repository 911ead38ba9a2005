"""Registered queries of the fuzzy-matching engine: (spark, sf_dir) -> frame."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import GramConfig, Pad, char_count, contains, count_gram, count_grams, explode_grams, from_pandas, gram_map, identity, is_empty, pad_text, strip_scheme
from ..operators import Corpus, CorpusBuilder, compare_pairs, match_pairs, ngram_rows, search_batch, similarity_join
from ..operators.search import search
from ..sources.shared import shared_dir
from ..sources.texts import words_of
from ..streaming import append_stream, generations, search_stream

CUSTOM = GramConfig(2, Pad.of("--"), Pad.of("++"))
LEFT_ONLY = GramConfig(2, Pad.auto(), Pad.none())
NO_PAD = GramConfig(1, Pad.none(), Pad.none())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct()


def name_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return CorpusBuilder().fill(names(spark, sf_dir), "p_name").finish()


def vocabulary(spark: SparkSession, sf_dir: str) -> Corpus:
    return CorpusBuilder().fill(words_of(table(spark, sf_dir, "documents"), "text")).finish()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_corpus(spark, sf_dir).search("red wigdet", 0.25, 10)


def _grams(source: str, column: str, config: GramConfig, spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_grams(table(spark, sf_dir, source), column, config)


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = pad_text(F.col("p_name"), GramConfig())
    return names(spark, sf_dir).select(F.col("p_name").alias("text"), padded.alias("padded"), gram_map(padded, 2).alias("grams"))


def count_grams_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps(spark, sf_dir).select("text", count_grams(char_count(F.col("padded")), 2).cast("long").alias("n"))


def count_gram_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps(spark, sf_dir).select("text", count_gram(F.col("grams"), "d ").cast("long").alias("n"))


def contains_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps(spark, sf_dir).filter(contains(F.col("grams"), "ge")).select("text")


def gram_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("text"))
    return regions.select("text", is_empty(char_count(F.col("text")), 5).alias("empty"))


def gram_count_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    grams = explode_grams(items, "text", GramConfig(3, Pad.none(), Pad.none()))
    return items.join(grams, "text").select("item_id", "gram", "cnt")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = names(spark, sf_dir)
    left = one.select(F.col("p_name").alias("a"), F.substring_index("p_name", " ", 1).alias("first"))
    right = one.select(F.col("p_name").alias("b"), F.substring_index("p_name", " ", 1).alias("first"))
    return left.join(right, "first").select("a", "b")


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_pairs(_pairs(spark, sf_dir), "a", "b", GramConfig())
    return out.select("a", "b", F.col("same").alias("n_same"), F.col("all").alias("n_all"), F.col("diff").alias("n_diff"))


def _pair_similarity(warp: float, digits: int | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_pairs(_pairs(spark, sf_dir), "a", "b", GramConfig(), warp)
    sim: Column = F.col("similarity") if digits is None else F.round("similarity", digits)
    return out.select("a", "b", sim.alias("sim"))


def warp_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = compare_pairs(_pairs(spark, sf_dir), "a", "b", GramConfig(), 0.5).select("a", "b", F.col("similarity").alias("low"))
    high = compare_pairs(_pairs(spark, sf_dir), "a", "b", GramConfig(), 9.0).select("a", "b", F.col("similarity").alias("high"))
    return low.join(high, ["a", "b"])


def matches_threshold_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("a"), F.col("r_regionkey").alias("k"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("k"))
    found = match_pairs(regions.join(nations, "k").select("a", "b"), "a", "b", GramConfig(3, Pad.none(), Pad.none()), 0.0)
    return found.withColumnRenamed("similarity", "sim")


def matches_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pairs of names, both ways round: candidates come from the prefix
    join, the comparison is that of given pairs."""
    near = similarity_join(name_corpus(spark, sf_dir), 0.6)
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    same = names(spark, sf_dir).select(F.col("p_name").alias("a"), F.col("p_name").alias("b"))
    pairs = near.select(F.explode(both).alias("pair")).select("pair.a", "pair.b").unionByName(same)
    return match_pairs(pairs, "a", "b", GramConfig(), 0.6).withColumnRenamed("similarity", "sim")


def distinct_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of n-grams: padded text and arity."""
    parts = table(spark, sf_dir, "part")
    rows = ngram_rows(parts, "p_type", GramConfig()).unionByName(ngram_rows(parts, "p_type", GramConfig(3)))
    return rows.dropDuplicates(["text_padded", "arity"]).select("text", "text_padded", "arity", F.col("n_chars").alias("n_chars"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).postings.select("gram", "text", "n_chars", "cnt")


def gram_df_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vocabulary(spark, sf_dir).postings.groupBy("gram").agg(F.count("*").alias("df"))
    return found.orderBy(F.desc("df"), "gram").limit(20)


def _search(text: str, threshold: float, limit: int, warp: float, digits: int | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(name_corpus(spark, sf_dir), text, threshold, limit, warp, double=True)
    return found if digits is None else found.withColumn("similarity", F.round("similarity", digits))


def search_case_insensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = CorpusBuilder().fill(table(spark, sf_dir, "part"), "p_type").case_insensitive().finish()
    return search(corpus, "EcOnomi", 0.1, 10, double=True)


def url_corpus(spark: SparkSession, sf_dir: str, *, clean: bool) -> Corpus:
    builder = CorpusBuilder().fill(table(spark, sf_dir, "pages"), "url")
    return (builder.link_key_transformer(strip_scheme).case_insensitive() if clean else builder).finish()


def search_transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(url_corpus(spark, sf_dir, clean=True), "HTTP://WWW.Example.org/en/", 0.3, 10, double=True)


def search_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(vocabulary(spark, sf_dir), "pathetik", 0.4, 10, double=True)


def batch_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = words_of(table(spark, sf_dir, "benchmark"), "text")
    found = search_batch(vocabulary(spark, sf_dir), queries, "text", 0.7, 3)
    return found.select("query", F.col("rank").cast("long").alias("rank"), "text", "similarity")


def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = CorpusBuilder().fill(table(spark, sf_dir, "nation"), "n_name").case_insensitive().finish()
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("query"))
    nations = table(spark, sf_dir, "nation").select(F.upper("n_name").alias("query"))
    return corpus.keys(regions.unionByName(nations), "query")


def corpus_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region")
    full = CorpusBuilder().arity(5).pad_full(Pad.none()).fill(regions, "r_name").finish().words
    none = CorpusBuilder().fill(regions.filter("r_regionkey < 0"), "r_name").finish().words
    counted = [w.agg((F.count("*") == 0).alias("empty")).select(F.lit(n).alias("corpus"), "empty") for n, w in (("full", full), ("none", none))]
    return counted[0].unionByName(counted[1])


def add_text_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = CorpusBuilder().fill(table(spark, sf_dir, "region"), "r_name").finish()
    grown = corpus.add_text(table(spark, sf_dir, "nation"), "n_name").add_text(table(spark, sf_dir, "region"), "r_name")
    return search(grown, "AMERIKA", 0.05, 10, double=True)


def add_ngram_mixed_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region")
    corpus = CorpusBuilder().fill(regions, "r_name").finish()
    spaced = regions.select(F.concat(F.lit(" "), "r_name", F.lit(" ")).alias("t"))
    mixed = corpus.add_ngram(ngram_rows(spaced, "t", GramConfig(2, Pad.none(), Pad.none()))).add_ngram(ngram_rows(regions.filter("r_regionkey = 1"), "r_name", CUSTOM))
    return search(mixed, "AMERICA", 0.1, 10, double=True)


def url_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity_join(url_corpus(spark, sf_dir, clean=False), 0.5, strategy="blocks")
    return out.select("a", "b", F.col("same").alias("n_same"), F.col("all").alias("n_all"), F.col("similarity").alias("sim"))


def url_similarity_join_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity_join(url_corpus(spark, sf_dir, clean=False), 0.8, strategy="blocks")
    return out.select("a", "b", F.col("similarity").alias("sim"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def corpus_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "corpus")
    name_corpus(spark, sf_dir).save(path)
    return Corpus.load(spark, path).postings.select("gram", "text", "n_chars", "cnt")


def saved_corpus_grows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, loaded, grown, saved and loaded again, with its transformer."""
    path = _folder(spark, "corpus")
    CorpusBuilder().fill(table(spark, sf_dir, "region"), "r_name").case_insensitive().finish().save(f"{path}/a")
    Corpus.load(spark, f"{path}/a").add_text(table(spark, sf_dir, "nation"), "n_name").save(f"{path}/b")
    return search(Corpus.load(spark, f"{path}/b"), "NATIOM 1", 0.2, 10, double=True)


def fill_par(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = CorpusBuilder().fill_par(table(spark, sf_dir, "nation"), "n_name").fill_par(table(spark, sf_dir, "region"), "r_name").finish()
    return corpus.postings.select("gram", "text", "n_chars", "cnt")


def _single(found: DataFrame) -> DataFrame:
    return found.select("text", F.round(F.col("similarity").cast("double"), 4).alias("similarity"))


def search_par(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(name_corpus(spark, sf_dir).search_par("red wigdet", 0.25, 10))


def search_with_warp_par(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(name_corpus(spark, sf_dir).search_with_warp_par("old wigdet", 1.5, 0.2, 10))


def identity_transformer(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = CorpusBuilder().fill(names(spark, sf_dir), "p_name").link_key_transformer(identity).finish()
    return search(corpus, "cold rign", 0.3, 10, double=True)


def corpus_repr(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = CorpusBuilder().fill(table(spark, sf_dir, "region"), "r_name").case_insensitive().finish()
    return spark.createDataFrame([(repr(corpus),)], "value string")


def emoji_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = CorpusBuilder().arity(1).pad_full(Pad.none()).fill(["😏🍆", "ba", "cd"], spark=spark).finish()
    return search(corpus, "🍆d", 0.3, 10, double=True)


def pandas_transformer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transformer of the user's own, of texts and queries alike."""
    backwards = from_pandas(lambda s: s.str[::-1], "backwards")
    corpus = CorpusBuilder().fill(table(spark, sf_dir, "region"), "r_name").link_key_transformer(backwards, "backwards").finish()
    return search(corpus, "AMERIKA", 0.05, 10, double=True)


def streamed_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of queries, answered a file at a time."""
    path = _folder(spark, "stream")
    asked = table(spark, sf_dir, "nation").select(F.col("n_name").alias("q"))
    asked.repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("q string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    corpus = CorpusBuilder().fill(table(spark, sf_dir, "region"), "r_name").fill(table(spark, sf_dir, "nation"), "n_name").finish()

    def keep(found: DataFrame, number: int) -> None:
        found.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    search_stream(corpus, stream, "q", keep, 0.6, 3, checkpoint=f"{path}/progress").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("query", F.col("rank").cast("long").alias("rank"), "text", "similarity")


def streamed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus grown by a stream that is stopped and started again."""
    path = _folder(spark, "stream")
    corpus = CorpusBuilder().fill(table(spark, sf_dir, "region"), "r_name").finish()
    for part in range(2):
        half = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 2 == part)
        half.select(F.col("n_name").alias("t")).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("t string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        append_stream(stream, "t", f"{path}/corpus", corpus, checkpoint=f"{path}/progress").awaitTermination()
    last = generations(spark, f"{path}/corpus")[-1]
    return Corpus.load(spark, f"{path}/corpus/{last}").words.select("text", "text_padded", "arity", "n_chars")


QUERIES = {
    "gram_counts_a2_auto": partial(_grams, "part", "p_name", GramConfig()),
    "gram_counts_a1_nopad": partial(_grams, "part", "p_name", NO_PAD),
    "gram_counts_a3_auto": partial(_grams, "part", "p_name", GramConfig(3)),
    "gram_counts_a5": partial(_grams, "region", "r_name", GramConfig(5, Pad.none(), Pad.none())),
    "gram_counts_custom_pad": partial(_grams, "nation", "n_name", CUSTOM),
    "gram_counts_left_only": partial(_grams, "nation", "n_name", LEFT_ONLY),
    "gram_counts_arity_clamped": partial(_grams, "region", "r_name", GramConfig(0)),
    "count_grams_total": count_grams_total,
    "count_gram_lookup": count_gram_lookup,
    "contains_filter": contains_filter,
    "gram_is_empty": gram_is_empty,
    "gram_count_unicode": gram_count_unicode,
    "distinct_ngrams": distinct_ngrams,
    "pair_counts": pair_counts,
    "pair_similarity_w1": partial(_pair_similarity, 1.0, None),
    "pair_similarity_w2": partial(_pair_similarity, 2.0, None),
    "pair_similarity_w3": partial(_pair_similarity, 3.0, None),
    "pair_similarity_w25": partial(_pair_similarity, 2.5, 6),
    "warp_clamp": warp_clamp,
    "matches_threshold_zero": matches_threshold_zero,
    "matches_threshold": matches_threshold,
    "postings": postings,
    "gram_df_topk": gram_df_topk,
    "search_topk": partial(_search, "red wigdet", 0.25, 10, 2.0, None),
    "search_warp": partial(_search, "red wigdet", 0.25, 10, 1.5, 6),
    "search_limit": partial(_search, "cold rign", 0.1, 3, 2.0, None),
    "search_threshold_zero": partial(_search, "zq wi", 0.0, 1000, 2.0, None),
    "search_case_insensitive": search_case_insensitive,
    "search_transform_chain": search_transform_chain,
    "search_vocab": search_vocab,
    "batch_search_topk": batch_search_topk,
    "key_lookup": key_lookup,
    "corpus_is_empty": corpus_is_empty,
    "add_text_incremental": add_text_incremental,
    "add_ngram_mixed_pad": add_ngram_mixed_pad,
    "url_similarity_join": url_similarity_join,
    "url_similarity_join_pruned": url_similarity_join_pruned,
    "corpus_roundtrip": corpus_roundtrip,
    "saved_corpus_grows": saved_corpus_grows,
    "fill_par": fill_par,
    "search_par": search_par,
    "search_with_warp_par": search_with_warp_par,
    "identity_transformer": identity_transformer,
    "pandas_transformer": pandas_transformer,
    "corpus_repr": corpus_repr,
    "emoji_search": emoji_search,
    "streamed_searches": streamed_searches,
    "streamed_corpus": streamed_corpus,
}
