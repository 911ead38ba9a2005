import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkgrams.functions import GramConfig, Pad, contains, count_gram, count_grams, explode_grams, gram_map, is_empty, ngrams, pad_text

DASHES = (Pad.of("--"), Pad.of("++"))


def grams_of(spark, text, config):
    row = spark.range(1).select(gram_map(pad_text(F.lit(text), config), config.arity).alias("m")).first()
    return row.m


@pytest.mark.parametrize(
    ("text", "config", "expected"),
    [
        ("", GramConfig(1, Pad.none(), Pad.none()), {}),
        ("", GramConfig(2, *DASHES), {"--": 1, "-+": 1, "++": 1}),
        ("", GramConfig(2, Pad.none(), Pad.none()), {}),
        ("", GramConfig(), {"  ": 1}),
        ("ab", GramConfig(2, Pad.none(), Pad.none()), {"ab": 1}),
        ("ab", GramConfig(), {" a": 1, "ab": 1, "b ": 1}),
        ("ab", GramConfig(2, *DASHES), {"--": 1, "-a": 1, "ab": 1, "b+": 1, "++": 1}),
        ("tomato", GramConfig(), {" t": 1, "to": 2, "om": 1, "ma": 1, "at": 1, "o ": 1}),
        ("😏🍆x", GramConfig(2, Pad.none(), Pad.none()), {"😏🍆": 1, "🍆x": 1}),
        ("a\nb", GramConfig(2, Pad.none(), Pad.none()), {"a\n": 1, "\nb": 1}),
        ("aba", GramConfig(0), {"a": 2, "b": 1}),
        ("ab", GramConfig(5, Pad.none(), Pad.none()), {}),
        (None, GramConfig(), None),
    ],
)
def test_gram_map(spark, text, config, expected):
    assert grams_of(spark, text, config) == expected


def test_arity_three_and_left_pad(spark):
    assert "tom" in grams_of(spark, "tomato", GramConfig(3))
    assert " t" in grams_of(spark, "tomato", GramConfig(2, Pad.of(" "), Pad.auto()))


def test_counts(spark):
    df = spark.createDataFrame([("tomato",), ("",)], "t string")
    p = pad_text(F.col("t"), GramConfig())
    m = gram_map(p, 2)
    rows = df.select(count_gram(m, "to"), count_gram(m, "zz"), contains(m, "om"), count_grams(F.length(p), 2), is_empty(F.length(p), 3)).collect()
    assert [tuple(r) for r in rows] == [(2, 0, True, 7, False), (0, 0, False, 1, True)]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=12), min_size=1, max_size=6), st.integers(1, 4))
def test_windows_match_python(spark, texts, n):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ngrams(F.col("t"), n).alias("g")).collect()
    assert [(r.t, r.g) for r in got] == [(t, [t[i : i + n] for i in range(len(t) - n + 1)]) for t in texts]


def test_explode_distinct_without_nulls(spark):
    df = spark.createDataFrame([("aa",), ("aa",), (None,)], "t string")
    got = explode_grams(df, "t", GramConfig(1)).collect()
    assert [tuple(r) for r in got] == [("aa", "a", 2)]
