import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrams.llm.hamming_search import MultiIndex, search_codes
from sparkgrams.llm.oracles import OP9
from sparkgrams.llm.queries import op9_hamming_topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        near = sorted((sum((a > 0) != (b > 0) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
        out |= {(q, n): (i, d) for n, (d, i) in enumerate(near[:k], 1)}
    return out


def got(df):
    return {(r.query_id, r["rank"]): (r.neighbor_id, r.distance) for r in df.collect()}


def test_against_sql(spark, sf_dir, duck, same_rows):
    same_rows(op9_hamming_topk(spark, sf_dir).toPandas(), duck.execute(OP9).df())


@pytest.mark.parametrize(("bits", "width", "block"), [(24, 8, 4096), (70, None, 64), (24, 4, 4096)])
def test_against_brute_force(spark, bits, width, block):
    r = random.Random(bits)
    base = [[r.uniform(-1, 1) for _ in range(bits)] for _ in range(8)]
    rows = [(n, [x if r.random() > 0.08 else -x for x in r.choice(base)]) for n in range(150)] + [(n, base[0]) for n in range(200, 230)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.filter("vec_id % 10 = 0")
    found = got(search_codes(df, asked, 5, width=width, query_block=block))
    assert found == brute(rows, [x for x in rows if x[0] % 10 == 0], 5)


def test_edge_rows(spark):
    rows = [(1, [1.0, 1.0]), (1, [1.0, -1.0]), (2, None), (3, []), (None, [1.0, 1.0]), (4, [1.0, None]), (5, [1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("clash")).withColumn("qid", F.lit(0))
    assert got(search_codes(df, df.filter("vec_id = 4"), 9)) == {(4, 1): (1, 0), (4, 2): (5, 0), (4, 3): (1, 1)}
    assert got(search_codes(df.limit(0), df, 3)) == {} == got(search_codes(df, df.limit(0), 3))


@pytest.mark.parametrize(("bits", "n"), [(768, 6), (600, 3)])
def test_small_table_of_long_vectors(spark, bits, n):
    r = random.Random(bits)
    rows = [(i, [r.choice((-1.0, 1.0)) for _ in range(bits)]) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(search_codes(df, df, 10)) == brute(rows, rows, 10)


def test_string_ids_and_repeated_queries(spark):
    r = random.Random(1)
    rows = [(f"v{n}", [r.uniform(-1, 1) for _ in range(20)]) for n in range(40)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    assert got(search_codes(df, df.limit(9), 4)) == brute(rows, rows[:9], 4)
    twice = spark.createDataFrame([("q", [-1.0] * 20), ("q", [1.0] * 20), ("q", [-1.0] * 20)], df.schema)
    assert got(search_codes(df, twice, 4)) == brute(rows, [("q", [-1.0] * 20)], 4)


@pytest.mark.parametrize(("bits", "width"), [(64, None), (64, 16), (70, 5), (3, 4)])
def test_radius_grows_until_covered(bits, width):
    rng = np.random.default_rng(bits)
    flat = rng.integers(0, 2, (400, bits)).astype(np.uint64)
    flat[:40] = flat[0]
    flat[np.arange(40), rng.integers(0, bits, 40)] ^= np.uint64(1)
    words = np.zeros((400, -(-bits // 64)), np.uint64)
    for b in range(bits):
        words[:, b // 64] |= flat[:, b] << np.uint64(b % 64)
    words = np.unique(words, axis=0)
    index = MultiIndex(words, np.ones(len(words), np.int64), bits, width)
    for at in range(0, len(words), 7):
        apart = np.bitwise_count(words ^ words[at]).sum(axis=1)
        for segment, (_, _, w, *_) in enumerate(index.segments):
            assert sorted(np.concatenate([index.shell(words[at], segment, r) for r in range(w + 1)]).tolist()) == list(range(len(words)))
        found, d, radius = index.nearest(words[at], 5, bits)
        last = np.sort(apart)[min(5, len(words) - 1)]
        assert sorted(found.tolist()) == np.flatnonzero(apart <= last).tolist() and (apart[found] == d).all()
        assert (len(index.segments) * radius - 1) <= last or len(words) <= 6
