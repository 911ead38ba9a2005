from sparkgrams import Corpus, CorpusBuilder
from sparkgrams.streaming import append_stream, generations, search_stream


def test_search_stream(spark, tmp_path):
    corpus = CorpusBuilder().fill(["tomato", "pie"], spark=spark).finish().cache()
    spark.createDataFrame([("tomacco",), ("pied",)], "q string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("q string").parquet(f"{tmp_path}/in")
    out = {}
    search_stream(corpus, stream, "q", lambda df, n: out.update({(r["query"], r["rank"]): r.text for r in df.collect()}), 0.25, checkpoint=f"{tmp_path}/ck").awaitTermination()
    assert out == {("tomacco", 1): "tomato", ("pied", 1): "pie"}


def test_append_stream(spark, tmp_path):
    corpus = CorpusBuilder().fill(["pie"], spark=spark).finish()
    spark.createDataFrame([("tomato",)], "t string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t string").parquet(f"{tmp_path}/in")
    append_stream(stream, "t", f"{tmp_path}/corpus", corpus, checkpoint=f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.text for r in Corpus.load(spark, f"{tmp_path}/corpus/0").words.collect()) == ["pie", "tomato"]


def test_append_stream_goes_on_after_a_restart(spark, tmp_path):
    corpus = CorpusBuilder().fill(["pie"], spark=spark).finish()
    for number, word in enumerate(("tomato", "banana")):
        spark.createDataFrame([(word,)], "t string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("t string").parquet(f"{tmp_path}/in")
        append_stream(stream, "t", f"{tmp_path}/corpus", corpus, checkpoint=f"{tmp_path}/ck").awaitTermination()
        assert generations(spark, f"{tmp_path}/corpus") == list(range(number + 1))
    assert sorted(r.text for r in Corpus.load(spark, f"{tmp_path}/corpus/1").words.collect()) == ["banana", "pie", "tomato"]
    assert generations(spark, f"{tmp_path}/nowhere") == []
