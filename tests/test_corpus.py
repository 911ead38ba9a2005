import math

import pytest
from pyspark.sql import functions as F

from sparkgrams import Corpus, CorpusBuilder, GramConfig, Pad, search_batch, similarity_join
from sparkgrams.functions import from_pandas, strip_scheme
from sparkgrams.operators import ngram_rows
from sparkgrams.plans import queries

UNIGRAM = (1, Pad.none())


def corpus(spark, texts, arity=2, pad=None, lower=False):
    builder = CorpusBuilder().arity(arity).pad_full(pad or Pad.auto()).fill(texts, spark=spark)
    return (builder.case_insensitive() if lower else builder).finish()


def found(df):
    return [(r.text, round(r.similarity, 4)) for r in df.collect()]


def test_readme_example(spark):
    c = corpus(spark, ["pie", "animal", "tomato", "seven", "carbon"])
    assert found(c.search("tomacco", 0.25, 10)) == [("tomato", 0.75)]
    assert dict(c.search("tomacco", 0.25).dtypes) == {"text": "string", "similarity": "float"}


@pytest.mark.parametrize(("lower", "texts", "queries"), [(False, ["ab", "ba", "cd"], ["ce", "ec", "b"]), (True, ["Ab", "Ba", "Cd"], ["ce", "ec", "b"]), (True, ["Ab", "Ba", "Cd"], ["cE", "eC", "b"])])
def test_search_counts(spark, lower, texts, queries):
    c = corpus(spark, texts, *UNIGRAM, lower=lower)
    got = [found(c.search(q, t, 10)) for q, t in zip(queries, (0.3, 0.3, 0.5), strict=True)]
    assert got == [[("cd", 0.5556)], [("cd", 0.5556)], [("ab", 0.75), ("ba", 0.75)]]


def test_emoji(spark):
    c = corpus(spark, ["😏🍆", "ba", "cd"], *UNIGRAM)
    assert c.search("ac", 0.3).count() == 2
    assert c.search("🍆d", 0.3).count() == 2


def test_words_without_grams(spark):
    assert found(corpus(spark, ["ab"], 5, Pad.of(" "), True).search("a", 0.0)) == []
    assert found(corpus(spark, ["a"], 3, Pad.of(" "), True).search("", 0.0)) == []
    short = corpus(spark, ["ab"], 5, Pad.none())
    assert not short.is_empty() and short.key("ab") == "ab" and short.search("ab", 0.0).isEmpty()


def test_key(spark):
    c = corpus(spark, ["ab", "ba"])
    assert (c.is_empty(), c.key("ab"), c.key("ba"), c.key("zabba")) == (False, "ab", "ba", None)
    assert corpus(spark, ["Ab"], lower=True).key("AB") == "AB"
    assert corpus(spark, []).is_empty()


def test_builder_order_does_not_matter(spark):
    a = CorpusBuilder().arity(2).fill(["tomato"], spark=spark).arity(3).pad_left(Pad.none()).pad_right(Pad.none()).finish()
    assert a.words.first()["n_chars"] == 6
    assert "tom" in a.grams().first()["grams"]
    assert "CorpusBuilder" in repr(CorpusBuilder()) and "Corpus" in repr(a)


def test_case_insensitive_perfect_match(spark):
    assert found(corpus(spark, ["tomato"], lower=True).search("ToMaTo", 0.9)) == [("tomato", 1.0)]


def test_limits_warps_and_nan(spark):
    c = corpus(spark, ["tomato", "tomatoes", "potato", "tomato"]).cache()
    assert len(found(c.search("tomato", 0.1, 2))) == 2
    assert found(c.search("tomato", 0.1, 0)) == []
    assert found(c.search("tomato", 1.1)) == []
    assert found(c.search("tomato", math.nan)) == [] == found(c.search_with_warp("tomato", math.nan, 0.1))
    low, high = (dict(found(c.search("tomacco", 0.1, warp=w))) for w in (1.0, 3.0))
    assert all(low[t] < high[t] for t in low)
    assert found(c.search_par("tomato", 0.5)) == found(c.search("tomato", 0.5))
    c.unpersist()


def test_add_text_and_ngram(spark):
    c = corpus(spark, ["tomato"]).add_text("tomacco").add_text(["tomato", "x"])
    assert sorted(r.text for r in c.words.collect()) == ["tomacco", "tomato", "x"]
    rows = spark.createDataFrame([("tomato",)], "t string")
    grown = corpus(spark, []).add_ngram(ngram_rows(rows, "t", GramConfig()))
    assert found(grown.search("tomacco", 0.4)) == [("tomato", 0.75)]
    # other pads replace the word's row; another arity shares no gram
    bare = c.add_ngram(ngram_rows(rows, "t", GramConfig(2, Pad.none(), Pad.none())))
    assert dict(found(bare.search("tomato", 0.1)))["tomato"] < 1
    assert "tomato" not in dict(found(c.add_ngram(ngram_rows(rows, "t", GramConfig(3))).search("tomato", 0.0)))


def test_equal_padded_texts_are_one_result(spark):
    spaced = spark.createDataFrame([(" ab ",)], "t string")
    c = corpus(spark, ["ab"]).add_ngram(ngram_rows(spaced, "t", GramConfig(2, Pad.none(), Pad.none())))
    assert found(c.search("ab", 0.9)) == [(" ab ", 1.0)]


def test_transformers(spark):
    c = CorpusBuilder().fill(["HTTP://A.org/x"], spark=spark).link_key_transformer(strip_scheme).case_insensitive().finish()
    assert found(c.search("https://a.ORG/x", 0.9)) == [("a.org/x", 1.0)]
    upside = from_pandas(lambda s: s.str[::-1], "reversed")
    assert CorpusBuilder().fill(["abc"], spark=spark).link_key_transformer(upside, "reversed").finish().words.first()["text"] == "cba"


def test_save_and_load(spark, tmp_path):
    c = corpus(spark, ["Tomato", "pie", None], 3, lower=True)
    c.save(f"{tmp_path}/c")
    back = Corpus.load(spark, f"{tmp_path}/c")
    assert (back.config, back.transformer.names) == (c.config, ["lower"])
    assert sorted(map(tuple, back.postings.collect())) == sorted(map(tuple, c.postings.collect()))
    assert back.key("TOMATO") == "TOMATO"
    with pytest.raises(ValueError, match="registered"):
        type(c.transformer).from_names(["nowhere"])


def test_batch_equals_single(spark):
    c = corpus(spark, ["tomato", "tomatoes", "potato", "pie", "spied"]).cache()
    queries = spark.createDataFrame([("tomacco",), ("pied",), ("pied",), ("",), (None,)], "q string")
    for n in (None, 5):
        rows = search_batch(c, queries, "q", 0.2, 2, n_queries=n).collect()
        for q in ("tomacco", "pied", ""):
            single = [(r.text, round(r.similarity, 4)) for r in c.search(q, 0.2, 2).collect()]
            assert [(r.text, round(r.similarity, 4)) for r in sorted(rows, key=lambda r: r["rank"]) if r["query"] == q] == single


def test_pruning_loses_nothing(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", r"\s+")).alias("w")).filter("w <> ''").distinct().orderBy(F.xxhash64("w")).limit(400)
    c = CorpusBuilder().fill(words, "w").finish().cache()
    for threshold in (0.6, 0.8, 0.95):
        a, b = (set(map(tuple, similarity_join(c, threshold, strategy=s).collect())) for s in ("prefix", "index"))
        assert a == b
    c.unpersist()


def test_blocks_lose_nothing(spark, sf_dir):
    from sparkgrams.operators.blocks import all_pairs, signatures

    words = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("w")).limit(60)
    odd = spark.createDataFrame([(w,) for w in ("", "a", "aaaa", "aaaaa", "ß😏ß", "ß😏", "https://a.b/c", "https://a.b/d", None)], "w string")
    c = CorpusBuilder().fill(words.unionByName(odd), "w").finish()
    c = c.add_ngram(ngram_rows(odd.limit(3), "w", GramConfig(2, Pad.none(), Pad.none()))).cache()
    for threshold, warp in ((0.0, 2.0), (0.5, 2.0), (0.8, 1.0), (0.8, math.nan)):
        a, b = (sorted(map(tuple, similarity_join(c, threshold, warp, strategy=s).collect())) for s in ("blocks", "index"))
        assert a == b
    # one word of bits: most tokens are in the rest
    texts = c.words.filter("arity = 2")
    assert signatures(texts, 2, 1).filter("more > 0").count() > 30
    a, b = ({(r.a, r.b, r.same, r["all"]) for r in found.collect()} for found in (all_pairs(texts, 2, 0.0, 1), all_pairs(texts, 2, 0.0)))
    assert a == b and len(a) > 1000
    c.unpersist()


@pytest.mark.parametrize("name", ["url_similarity_join", "url_similarity_join_pruned"])
def test_pairs_of_urls_are_not_shuffled(spark, sf_dir, name):
    """Each pair is met once, in its cell, and judged there."""
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above, _, join = plan.partition("Join Inner")
    assert "Aggregate" not in above and "Repartition" not in above
    assert "cell" in join.splitlines()[0] and "gram" not in join.splitlines()[0] and "token" not in join.splitlines()[0]
