import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import zstandard
from pyspark.sql import functions as F

from sparkgrams.llm import toxicity
from sparkgrams.llm.quality import fit_quality, score_quality, train_quality
from sparkgrams.llm.queries import op6_toxicity, op7_quality
from sparkgrams.llm.toxicity import calibrate, fit_toxicity, hashed, platt, score_toxicity, train_ftrl


def texts(seed, n, bad):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 80))]
        labels.append(i % 4 == 0)
        if labels[-1]:
            w = bad(r, w)
        out.append(" ".join(w).encode())
    return out, [int(x) for x in labels]


def insult(r, w):
    for _ in range(3):
        w.insert(r.randrange(len(w)), r.choice(["fool!", "Dolt", "oaf,"]))
    return w


def test_ftrl_is_sparse_and_accurate():
    x, y = texts(1, 600, insult)
    model = train_ftrl(x, y, decision=0.7)
    a, b = texts(2, 300, insult)
    predicted = model.scores(a) >= 0.7
    assert (predicted == np.array(b, bool)).mean() > 0.95
    assert len(model.features) < 2000
    assert model.scores([b""])[0] == model.scores([b" .. "])[0]


def plain_ftrl(texts, labels, order, bits, l1, alpha=0.5, beta=1.0, l2=1.0, epochs=2):
    """One weight at a time, in dictionaries."""
    z, n, bias, bias_n = defaultdict(float), defaultdict(float), 0.0, 0.0
    sets = [sorted(set(hashed(t, bits).tolist())) for t in texts]

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(epochs):
        for row in order:
            w = {k: weight(k) for k in sets[row]}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - labels[row]
            for k in sets[row]:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
    return bias, {k: weight(k) for k in list(z) if weight(k)}


def test_ftrl_against_plain():
    x, y = texts(1, 200, insult)
    model = train_ftrl(x, y, bits=18, l1=0.5)
    # the order that training takes, with a fifth held back
    rng = np.random.default_rng(7)
    order = rng.permutation(len(y))
    order = order[np.argsort(-np.array(y)[order], kind="stable")]
    learn = rng.permutation(np.delete(order, np.s_[::5]))
    bias, weights = plain_ftrl(x, y, learn.tolist(), 18, 0.5)
    assert math.isclose(bias, model.bias, rel_tol=1e-9) and set(weights) == set(model.features.tolist())
    assert np.allclose([weights[k] for k in model.features.tolist()], model.weights)
    for t in texts(2, 20, insult)[0]:
        logit = bias + sum(weights.get(k, 0.0) for k in set(hashed(t, 18).tolist()))
        assert math.isclose(model.scores([t])[0], 1 / (1 + math.exp(-(model.scale * logit + model.shift))), rel_tol=1e-4)


def test_quality_against_plain():
    junk = lambda r, w: [x + r.choice(["$$$", "%%%"]) for x in w]
    x, y = texts(3, 200, junk)
    model = train_quality(x, [1 - v for v in y], decision=0.7)
    for t in [b"", b"short", b" ".join(x[:40]), *x[:10]]:
        sizes = []
        for d in (model.good, model.bad):
            tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=model.level)
            sizes.append(sum(len(tool.compress(t[i : i + 2048])) for i in range(0, len(t), 2048)))
        assert model.differences([t])[0] == (sizes[1] - sizes[0]) / max(1, len(t))
        assert math.isclose(model.scores([t])[0], 1 / (1 + math.exp(-(model.scale * model.differences([t])[0] + model.shift))))


def test_features():
    assert len(hashed(b"", 20)) == 0 and len(hashed(b"one", 20)) == 1 and len(hashed(b"one two three", 20)) == 6
    assert np.array_equal(hashed(b"One, TWO", 20), hashed(b"one two", 20))


def test_quality_by_compression():
    junk = lambda r, w: [x + r.choice(["$$$", "%%%"]) for x in w]
    x, y = texts(3, 400, junk)
    model = train_quality(x, [1 - v for v in y], decision=0.7)
    a, b = texts(4, 200, junk)
    assert ((model.scores(a) >= 0.7) == (np.array(b) == 0)).mean() > 0.95
    scores = model.scores([b"", b"x", b"y" * 100_000])
    assert ((scores >= 0) & (scores <= 1)).all()


def test_one_kind_or_none():
    assert train_ftrl([b"a"], [1]).scores([b"b"])[0] > 0.5
    assert train_ftrl([], []).scores([b"b", b""]).tolist() == [0.5, 0.5]
    assert train_quality([], []).scores([b"b"]).tolist() == [0.5]
    assert platt(np.zeros(4), np.array([0, 1, 0, 1.0])) == (1.0, 0.0)
    scale, shift = calibrate(np.array([-2.0, -1, 1, 2]), np.array([0, 0, 1, 1.0]), 0.7)
    assert 1 / (1 + np.exp(-shift)) == 0.7 or abs(1 / (1 + np.exp(-(scale * 0 + shift))) - 0.7) < 1e-9


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for query, column, folds, fold in ((op6_toxicity, "toxic", 3, 1), (op7_quality, "quality", 4, 2)):
        got = query(spark, sf).join(labels, "doc_id").toPandas()
        held = got[got.held_out]
        assert all(h == (crc32(str(d).encode()) % folds == fold) for d, h in zip(got.doc_id, got.held_out, strict=True))
        assert ((got.score >= 0.7).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
        pos, neg = held[held[column] == 1].score, held[held[column] == 0].score
        assert np.mean([(a > neg).mean() + (a == neg).mean() / 2 for a in pos]) > 0.8


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "x"), (2, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, None, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for fit, score in ((fit_toxicity, score_toxicity), (fit_quality, score_quality)):
        model = fit(docs, labels)
        assert score(docs, model).filter("score between 0 and 1").count() == 4
        assert score(docs.limit(0), fit(docs.limit(0), labels.limit(0))).count() == 0


def test_repeated_ids_and_long_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c " * 300_000), (4, "d")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, None)], "doc_id long, toxic int").repartition(3)
    got = toxicity.training_rows(docs, labels, "toxic", F.lit(True), 100, "doc_id", "text")
    assert got == ([b"a", b"", b"c " * 300_000], [1, 0, 1])
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 1000)
    got = toxicity.training_rows(docs, labels, "toxic", F.lit(True), 100, "doc_id", "text")
    assert b"c " * 300_000 not in got[0]
    assert score_toxicity(docs, fit_toxicity(docs, labels)).count() == 5
