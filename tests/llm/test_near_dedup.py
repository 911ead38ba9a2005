import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import near_duplicates
from sparkgrams.llm import near_dedup
from sparkgrams.llm.components import connected_components
from sparkgrams.llm.near_dedup import drop_near_duplicates, link_near_duplicates


def got(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in link_near_duplicates(df, **kw).collect()}


def near_copies(seed, groups, copies):
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [str(r.randint(0, 9999)) for _ in range(r.randint(30, 90))]
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = str(r.randint(0, 9999))
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [32, 3])
def test_against_brute_force(spark, limit):
    rows = [*near_copies(limit, 12, 25), (1000, None), (1001, " \n"), (1002, "one two"), (1003, "ONE two"), (1004, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, shingle=4, region_limit=limit) == near_duplicates(rows, 4)


def test_boilerplate_hides_no_pair(spark):
    r = random.Random(3)
    common, texts = [f"c{n}" for n in range(173)], []
    for n in range(480):
        own = [f"w{r.randrange(10**9)}" for _ in range(27)]
        texts.append(" ".join(common + own))
        if n % 12 == 0:
            texts.append(" ".join(common + own[:6] + [f"w{r.randrange(10**9)}" for _ in range(21)]))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    exact = near_duplicates(rows, 4)
    assert sum(c != i for i, (_, c) in exact.items()) == 40
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, region_limit=3) == exact


def crowd(seed, variants=700, clusters=25):
    """Variants of one text, most of them less similar than the threshold, and
    tight groups of three among them."""
    r = random.Random(seed)
    base = [f"b{n}" for n in range(400)]

    def changed(w, n):
        w = list(w)
        for _ in range(n):
            w[r.randrange(len(w))] = f"x{r.randrange(10**9)}"
        return w

    texts = [changed(base, r.randint(8, 30)) for _ in range(variants)]
    for _ in range(clusters):
        core = changed(base, 32)
        texts += [changed(core, 3) for _ in range(3)]
    r.shuffle(texts)
    return [(n, " ".join(t)) for n, t in enumerate(texts)]


@pytest.mark.parametrize(("limit", "chunk"), [(32, 100_000), (3, 300)])
def test_crowded_regions_lose_no_link(spark, monkeypatch, limit, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rows = crowd(limit, *((700, 25) if limit == 32 else (300, 30)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, region_limit=limit) == near_duplicates(rows, 4)


def test_one_id_of_different_texts(spark):
    tail = " ".join(f"t{n}" for n in range(40))
    rows = [("5", "all alone here with its own words"), ("5", tail), ("3", tail + " more")]
    out = link_near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, out)) == [("3", 37, "3", True), ("5", 3, "5", True), ("5", 36, "3", False)]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted(map(tuple, kept.collect())) == sorted([rows[0], rows[2]])


def test_long_text(spark):
    words = [f"w{n % 9973}" for n in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "x", "y"])), (3, " ".join(words[:3000]))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == near_duplicates(rows, 5)


def test_orders():
    sig = near_dedup.signature(near_dedup.shingle_set(b"a b c d e f g h i", 4))
    other = sig.copy()
    other[10] += np.uint64(1)
    (k, r), (l, q) = near_dedup.orders(sig), near_dedup.orders(other)
    assert np.flatnonzero(k != l).tolist() == [2] and np.flatnonzero(r != q).tolist() == [0, 1]
    key = np.array([1, 1, 1, 1, 1, 7], np.uint64)
    rest = np.array([0, 0, 1 << 56, 1 << 56, 1 << 56, 0], np.uint64)
    leaf, begin, size = near_dedup._depths(key, rest, np.array([5, 5, 5, 5, 5, 1]), 3)
    assert begin.tolist() == [0, 0, 2, 2, 2, 5] and size.tolist() == [2, 2, 3, 3, 3, 1] and len(set(leaf.tolist())) == 3


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs, shingle=4) == near_duplicates([tuple(r) for r in docs.select("doc_id", "text").collect()], 4)


def test_edge_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("comp", F.lit(1)).withColumn("row", F.lit(0))
    out = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in link_near_duplicates(df).collect()]
    assert sorted(out, key=str) == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, None, True), (9, 2, 5, False), (7, 0, 7, True)], key=str)
    assert link_near_duplicates(df.limit(0)).count() == 0
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(kept.select("doc_id").toPandas()["doc_id"].fillna(-1)) == [-1, 5, 5, 7]


def test_components(spark):
    chain = [(n, n + 1) for n in range(20)] + [(100, 103), (103, 101), (50, 50)]
    found = {r.id: r.comp for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100, 103: 100, 50: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
