import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkgrams.functions import GramConfig, Pad, similarity, similarity_single
from sparkgrams.functions.similarity import matches
from sparkgrams.operators import compare_pairs, match_pairs
from sparkgrams.plans.pruning import jaccard_bound

SPACE = GramConfig(5, Pad.of(" "), Pad.of(" "))


@pytest.mark.parametrize(
    ("same", "all_", "warp", "expected"),
    [(5, 10, 1.0, 0.5), (5, 10, 2.0, 0.75), (5, 10, 3.0, 0.875), (2, 4, 2.0, 0.75), (3, 4, 1.0, 0.75), (0, 0, 2.0, 0.0), (5, 10, 0.2, 0.5), (5, 10, 9.0, 0.875), (5, 10, 2.5, 0.82322329)],
)
def test_raw(spark, same, all_, warp, expected):
    row = spark.range(1).select(similarity(F.lit(same), F.lit(all_), warp).alias("d"), similarity_single(F.lit(same), F.lit(all_), warp).alias("f")).first()
    assert row.d == pytest.approx(expected, rel=1e-6)
    assert row.f == pytest.approx(expected, rel=1e-6)


@pytest.mark.parametrize(
    ("a", "b", "config", "warp", "same", "all_", "sim"),
    [
        ("tomato", "tomacco", GramConfig(), 1, 5, 10, 0.5),
        ("tomato", "tomacco", GramConfig(), 2, 5, 10, 0.75),
        ("tomato", "tomacco", GramConfig(3), 2, 5, 12, 0.65972221),
        ("animal", "tomacco", GramConfig(), 2, 1, 14, 0.1377551),
        ("banana", "bananas", GramConfig(), 2, 6, 9, 0.8888889),
        ("aaaa", "aa", GramConfig(), 2, 3, 5, 0.84),
        ("ab", "ab", GramConfig(), 3, 3, 3, 1.0),
        ("ab", "cd", GramConfig(), 3, 0, 6, 0.0),
        ("ab", "ab", GramConfig(2, Pad.of("--"), Pad.of("++")), 2, 5, 5, 1.0),
        ("🍆d", "😏🍆", GramConfig(1, Pad.none(), Pad.none()), 2, 1, 3, 0.5555556),
        ("a", "ab", SPACE, 2, 0, 0, 0.0),
        ("", "a", GramConfig(3, Pad.of(" "), Pad.of(" ")), 2, 0, 0, 0.0),
    ],
)
def test_golden_pairs(spark, a, b, config, warp, same, all_, sim):
    row = compare_pairs(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b", config, warp).first()
    assert (row["same"], row["all"], row["diff"]) == (same, all_, all_ - same)
    assert row["similarity"] == pytest.approx(sim, rel=1e-6)
    back = compare_pairs(spark.createDataFrame([(b, a)], "a string, b string"), "a", "b", config, warp).first()
    assert back["similarity"] == row["similarity"]


def test_threshold(spark):
    pairs = spark.createDataFrame([("ab", "cd"), ("ab", "ab"), (None, "ab")], "a string, b string")
    assert match_pairs(pairs, "a", "b", GramConfig(), 0.0).count() == 2
    assert match_pairs(pairs, "a", "b", GramConfig(), 1.0).count() == 1
    assert match_pairs(pairs, "a", "b", GramConfig(), math.nan).count() == 0
    assert match_pairs(pairs, "a", "b", GramConfig(), 0.0, warp=math.nan).count() == 0


def test_inclusive_in_single_precision(spark):
    # 0.1 as a double is below its 32-bit neighbour
    assert spark.range(1).select(matches(F.lit(0.1), 0.1)).first()[0]


def test_bound():
    assert jaccard_bound(0.75, 2) == pytest.approx(0.5, abs=2e-5)
    assert jaccard_bound(0.0, 2) == 0 == jaccard_bound(math.nan, 2) == jaccard_bound(0.5, math.nan)


def test_pairs_are_intersected_once(spark):
    """However often a filter speaks of the similarity, and wherever it is pushed."""
    pairs = spark.createDataFrame([("tomato", "tomacco")], "a string, b string")
    plan = match_pairs(pairs.join(pairs.select(F.col("b").alias("c")), F.col("b") == F.col("c")), "a", "b", GramConfig(), 0.6)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("array_intersect") == 1
    assert text.count("regexp_extract_all") == 2


def test_pairs_of_repeats_and_nulls(spark):
    rows = [("aaaa", "aaa"), ("1:aa", "aa:1"), ("abab", "baba"), ("", ""), (None, "a"), ("a", None), ("ß😏ß", "ß😏")]
    pairs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a string, b string")
    out = compare_pairs(pairs, "a", "b", GramConfig(), 1.0)
    assert out.columns == ["id", "a", "b", "same", "all", "diff", "similarity"]
    got = {r.id: (r.same, r["all"], r["diff"]) for r in out.collect()}

    def brute(a, b):
        if a is None or b is None:
            return (None, None, None)
        x, y = (Counter(f" {t} "[i : i + 2] for i in range(len(t) + 1)) for t in (a, b))
        same, whole = (x & y).total(), (x | y).total()
        return (same, whole, whole - same)

    assert got == {i: brute(*r) for i, r in enumerate(rows)}
