import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import best_windows
from sparkgrams.llm.decontaminate import RADIUS, HammingBlocks, find_contamination, fingerprints, simhash, similarity
from sparkgrams.llm.licenses import SCAN
from sparkgrams.llm.words import hashes, runs


def words(text):
    return (text or "").encode().translate(SCAN).split()


def got(docs, items, **kw):
    return {(r.doc_id, r.item_id): r.similarity for r in find_contamination(docs, items, **kw).collect()}


def test_against_brute_force(spark):
    r = random.Random(5)
    word = lambda: str(r.randint(0, 400))
    items = [(n, " ".join(word() for _ in range(r.randint(1, 60)))) for n in range(30)] + [(90, None), (91, " .. ")]
    docs = []
    for n in range(120):
        w = [word() for _ in range(r.randint(0, 150))]
        if n % 2:
            leak = r.choice(items[:30])[1].split()
            for _ in range(r.randint(0, 3)):
                leak[r.randrange(len(leak))] = word()
            if r.random() < 0.3:
                leak.insert(r.randrange(len(leak) + 1), word())
            at = r.randint(0, len(w))
            w[at:at] = leak
        docs.append((n, ", ".join(w).upper()))
    docs += [(500, None), (501, ""), (502, items[3][1]), (503, " ".join(items[4][1].split()[:-1]))]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = best_windows(docs, items, words)
    for block in (2_000_000, 100):
        assert got(a, b, block_words=block) == expected
    assert len(expected) > 20


def test_whole_table(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = best_windows([tuple(x) for x in docs.select("doc_id", "text").collect()], [tuple(x) for x in items.collect()], words)
    assert got(docs, items) == expected and expected


def test_edge_rows(spark):
    text = " ".join(map(str, range(20)))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("start", F.lit(0))
    items = spark.createDataFrame([(7, text), (8, text), (None, text)], "item_id long, text string")
    found = find_contamination(docs, items)
    assert found.count() == 9 and found.filter("similarity = 1 and hamming = 0 and start = 0 and n_words = 20").count() == 9
    assert find_contamination(docs.limit(0), items).count() == 0 == find_contamination(docs, items.limit(0)).count()


def test_simhash_moves_little():
    a = [str(n).encode() for n in range(50)]
    far = bin(int(simhash(hashes(a))) ^ int(simhash(hashes(a[:-1] + [b"x"])))).count("1")
    assert far <= 10 and int(simhash(hashes(a))) != 0


def test_fingerprints_of_windows():
    h = hashes([str(n % 37).encode() for n in range(9000)])
    starts = np.array([0, 1, 5, 4999, 5000, 8960])
    for got, s in zip(fingerprints(h, starts, 40), starts, strict=True):
        assert got == simhash(h[s : s + 40])


@pytest.mark.parametrize(("n", "radius"), [(50, 20), (12_000, 9), (12_000, 20)])
def test_blocks_find_all_within_the_radius(n, radius):
    rng = np.random.default_rng(n)
    prints = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    index = HammingBlocks(prints, radius)
    for _ in range(30):
        own = prints[rng.integers(n)]
        for b in rng.choice(64, rng.integers(0, 24), replace=False):
            own ^= np.uint64(1 << int(b))
        found, apart = index.within(own)
        exact = np.bitwise_count(prints ^ own)
        assert found.tolist() == np.flatnonzero(exact <= radius).tolist() and (apart == exact[found]).all()
        assert [p[1:] for p in index.pairs(np.array([own, own])) if p[0]] == list(zip(found.tolist(), apart.tolist(), strict=True))


@pytest.mark.parametrize("size", [15, 25, 40, 60, 120, 400])
def test_radius_holds_windows_at_the_threshold(size):
    """Changed windows that are just similar enough: at least 99.5 % have
    fingerprints within the radius."""
    r, seen, near = random.Random(size), 0, 0
    while seen < 400:
        item = [f"w{r.randrange(10**6)}".encode() for _ in range(size)]
        other = list(item)
        if r.random() < 0.5:  # shifted against the item
            k = r.randint(1, max(1, size // 8))
            other = other[k:] + [f"x{r.randrange(10**6)}".encode() for _ in range(k)]
        for _ in range(r.randint(0, size // 20 + 1)):
            other[r.randrange(size)] = f"x{r.randrange(10**6)}".encode()
        a, b = hashes(item), hashes(other)
        alike = similarity(runs(a, 5), runs(b, 5))
        if not 0.8 <= alike < 0.9:
            continue
        seen += 1
        near += bin(int(simhash(a)) ^ int(simhash(b))).count("1") <= RADIUS
    assert near / seen >= 0.995


def test_long_text(spark):
    item = " ".join(f"i{n}" for n in range(50))
    text = " ".join([f"w{n % 5000}" for n in range(60_000)] + item.split() + ["end"] * 20_000)
    docs, items = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(3, item)], "item_id long, text string")
    assert [(r.start, r.n_words, r.similarity, r.hamming) for r in find_contamination(docs, items).collect()] == [(60_000, 50, 1.0, 0)]
