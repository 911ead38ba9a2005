from sparkgrams.llm.runtime import materialize, release, sieve, without


def test_without_and_sieve(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, "d")], "k long, row string")
    keys = spark.createDataFrame([(2,), (9,)], "k long")
    assert sorted(r.row for r in without(df, keys, "k").collect()) == ["a", "c", "d"]
    assert "b" in {r.row for r in sieve(df, keys, "k").collect()}
    assert without(df, keys.limit(0), "k").count() == 4


def test_materialize_in_the_shared_folder(spark):
    df = materialize(spark.range(3).toDF("id"), "kept")
    assert df.count() == 3 and spark.conf.get("spark.checkpoint.dir").removeprefix("file://") in df.inputFiles()[0]
    release(spark)
