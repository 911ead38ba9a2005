import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import repeats
from sparkgrams.llm.substring_dedup import SuffixTree, anchors, cut_repeats, prefix_lengths, remove_repeats
from sparkgrams.llm.words import runs, window_min


def got(df, **kw):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in cut_repeats(df, **kw).collect()}


def fixture(seed):
    r = random.Random(seed)
    base = [str(r.randint(0, 3)) for _ in range(60)]
    rows = [(n, " ".join(base[a : a + r.randint(0, 40)] + [str(r.randint(0, 2)) for _ in range(r.randint(0, 20))])) for n in range(60) for a in [r.randint(0, 40)]]
    return [*rows, (100, None), (101, ""), (102, "0 " * 14), (103, rows[5][1]), (104, "a  b\tc\nd")]


@pytest.mark.parametrize("limit", [1000, 3])
def test_against_brute_force(spark, limit):
    rows = fixture(limit)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, window=7, group_limit=limit) == repeats(rows, 7)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs) == repeats([tuple(r) for r in docs.select("doc_id", "text").collect()], 50)


def test_edge_rows(spark):
    text = " ".join(map(str, range(12)))
    rows = [(1, text), (1, text), (None, text), (2, text + " x"), (3, None), (1, "other words of one id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("rid", F.lit(1)).withColumn("words", F.lit(2))
    out = sorted(((r.doc_id is None, r.doc_id), r.n_words, r.n_removed) for r in cut_repeats(df, window=5).collect())
    assert [(k[1], n, m) for k, n, m in out] == [(1, 5, 0), (1, 12, 0), (1, 12, 0), (2, 13, 12), (3, 0, 0), (None, 12, 0)]
    assert cut_repeats(df.limit(0), window=5).count() == 0
    kept = remove_repeats(df, window=5)
    assert kept.columns == df.columns
    assert {r.text for r in kept.filter("doc_id = 2").collect()} == {"x"}


def test_copies_go(spark):
    text = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(1, text), (2, text), (3, "a b"), (4, "a b")], "doc_id long, text string")
    assert sorted(r.doc_id for r in remove_repeats(df).collect()) == [1, 3, 4]


def test_numeric_parts():
    h = np.random.default_rng(1).integers(0, 4, 400).astype(np.uint64)
    for n in (1, 2, 3, 7, 50):
        names = {}
        for i, g in enumerate(runs(h, n)):
            assert names.setdefault(tuple(h[i : i + n]), g) == g
        assert len(set(names.values())) == len(names)
        assert window_min(h, n).tolist() == [h[i : i + n].min() for i in range(len(h) - n + 1)]
    for size in prefix_lengths(21):
        key, at, n = anchors(h, 21, size)
        assert n.sum() == len(h) - 20 and at.tolist() == np.cumsum([0, *n[:-1]]).tolist()
        assert len(anchors(h[:20], 21, size)[0]) == 0
    assert prefix_lengths(50) == [16, 33, 42, 46, 50] and prefix_lengths(1) == [1]


def test_suffix_tree():
    r = random.Random(4)
    parts = [[r.randint(0, 2) for _ in range(r.randint(3, 30))] for _ in range(40)]
    lengths = np.array(list(map(len, parts)))
    suffixes = [tuple(p[i:]) for p in parts for i in range(len(p))]
    tree = SuffixTree(np.array([x for p in parts for x in p], np.uint64), lengths, np.arange(lengths.sum()))
    held = [suffixes[i] for i in tree.order]
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert tree.shared.tolist() == [0] + [common(a, b) for a, b in zip(held, held[1:], strict=False)]
    for depth in (1, 3, 7):
        node, deep = tree.nodes(depth)
        long = [(s[:depth], n) for s, n in zip(held, node, strict=True) if len(s) >= depth]
        assert len(set(long)) == len({s for s, _ in long}) == len({n for _, n in long})
        for n in set(node[deep[node] > 0].tolist()):
            below = [s for s, m in zip(held, node, strict=True) if m == n]
            assert len(below) > 1 and deep[n] == min(common(below[0], s) for s in below) >= depth


def periodic(seed, docs):
    """Lines of 9 words that many documents repeat, and a passage of all."""
    r = random.Random(seed)
    line, passage = [f"l{n}" for n in range(9)], [f"p{n}" for n in range(70)]
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    return [(n, " ".join(own(r.randint(0, 30)) + line * r.choice([1, 8, 12]) + own(r.randint(0, 9)) + passage[r.randint(0, 9) :] + own(20))) for n in range(docs)]


@pytest.mark.parametrize("limit", [4000, 20])
def test_hot_passages(spark, limit):
    rows = periodic(9, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, group_limit=limit) == repeats(rows, 50)


def test_long_text(spark, monkeypatch):
    from sparkgrams.llm import substring_dedup

    h = np.random.default_rng(1).integers(0, 9, 5000).astype(np.uint64)
    whole = anchors(h, 50, 16)
    monkeypatch.setattr(substring_dedup, "BLOCK", 700)
    cut = anchors(h, 50, 16)
    assert cut[2].sum() == whole[2].sum() and set(whole[0]) == set(cut[0])
    words = [f"w{n % 7000}" for n in range(40_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[100:30_000], "y"]))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == repeats(rows, 50)


def test_spans(spark):
    text = [f"w{n}" for n in range(80)]
    rows = [(1, " ".join(text)), (2, " ".join(["a", *text[:60], "b", *text[20:75], "c"])), (3, " ".join(text))]
    out = {r.doc_id: [tuple(s) for s in r.removed] for r in cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: [], 2: [(1, 60), (62, 55)], 3: [(0, 80)]}
