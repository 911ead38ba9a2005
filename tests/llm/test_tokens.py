import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from sparkgrams.llm import bpe  # noqa: E402
from sparkgrams.llm.packing import Packer, pack  # noqa: E402
from sparkgrams.llm.queries import op8_token_counts  # noqa: E402
from sparkgrams.llm.token_counts import PrefixCounts, count_tokens  # noqa: E402

ODD = [
    "", " ", "\n", "  a  b", "a\t b\n\nc ", "x\x1cy \x1f", "é é ΑΣ İx", "it's they'll 12 34,5 ½ ²", "<|endoftext|> a<|STARTOFTEXT|>", "a \n b\n",
    "\u3000x\xa0 y", "日本語 テスト", "🍆😏 z", "\r\na\r\n b", "'S 'LL don'T", "a\x00b \x85c", "don't. !!! $$$x", "x" * 5000,
]


@pytest.fixture(scope="module")
def texts(sf_dir):
    import pyarrow.parquet as pq

    r = random.Random(2)
    made = ["".join(r.choice(" \n\t\x1c\xa0a'sΣİé½2,.!́<|") for _ in range(r.randint(0, 14))) for _ in range(500)]
    return ODD + made + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(texts, name):
    e = bpe.encoder(P.path(name))
    for t in texts:
        assert np.frombuffer(e.ids(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_small_memory(texts, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 20)
    e = bpe.Encoder(P.path("byte_bpe_50k.json"))
    for t in texts[-20:]:
        assert np.frombuffer(e.ids(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


PREFIXED = [
    "Extraordinary  machines, they're 1234 here.", "ΑΣΣ naïve\x1cx", "<|endoftext|> abc", "a <|endoftext|>b", "x<|endoftext|><|endoftext|> y", " <|startoftext|>it's  <|endof",
    "they'll've 'rest ''s 'l", "\n\n\nabc\n  d   e", "x" * 200, "e\u0301 ȩ\u0301x",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_prefix_counts(texts, name):
    path = P.path(name)
    tok = bpe.encoder(path).tokenizer
    for t in PREFIXED + [t for t in texts[:300] if len(t) < 500]:
        table = PrefixCounts(t, path)
        exact = [len(tok.encode(t[:n], add_special_tokens=False).ids) for n in range(len(t) + 1)]
        assert [table.at(n) for n in range(len(t) + 1)] == exact == table.table.tolist()
        for budget in range(-1, 12):
            assert table.fit(budget) == max((n for n, c in enumerate(exact) if c <= budget), default=0)


def test_tokens_stay_apart():
    path, r = P.path("byte_bpe_50k.json"), random.Random(1)
    merges, model = bpe.Merges(path, 1000), bpe.encoder(path).model
    tokens = sorted(merges.tokens)
    assert len(tokens) > 50_000
    for a, b in [r.choices(tokens, k=2) for _ in range(3000)]:
        assert merges.apart(a, b) == ([t.value for t in model.tokenize(a + b)] == [a, b])


def test_long_text_is_linear():
    path, r = P.path("word_bpe_49k.json"), random.Random(1)
    text = "".join(r.choice(["word ", "naïve ", "x", "12 ", "'ll "]) for _ in range(300_000))
    table = PrefixCounts(text, path)
    assert table.at(len(text)) == len(bpe.encoder(path).tokenizer.encode(text, add_special_tokens=False).ids)
    n = table.fit(1000)
    assert table.at(n) <= 1000 and (table.table[n + 1 :] > 1000).all()


def test_query_against_the_library(spark, sf_dir):
    path = P.path("word_bpe_49k.json")
    tok = bpe.encoder(path).tokenizer
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op8_token_counts(spark, sf_dir).collect()}
    counts = dict(zip(docs, (len(e.ids) for e in tok.encode_batch(list(docs.values()), add_special_tokens=False)), strict=True))
    assert got == {i: (len(t.encode()), counts[i], counts[i] > 2048) for i, t in docs.items()}


def test_counts(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b"), (2, "a b"), (3, ODD[8]), (None, "a")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    path = P.path("word_bpe_49k.json")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(docs, path).collect()), key=str)
    assert got[:4] == [(0, 1, 1), (1, 0, 0), (2, 3, 2), (2, 3, 2)] and got[4][2] == len(bpe.encoder(path).tokenizer.encode(ODD[8], add_special_tokens=False).ids)
    assert count_tokens(docs.limit(0), path).count() == 0
    assert count_tokens(docs, path, budgets=(1,)).filter("doc_id = 2").first().fits_1 == 2
    assert count_tokens(docs, P.path("byte_bpe_50k.json"), budgets=(1, 0)).filter("doc_id = 2").select("fits_1", "fits_0").distinct().collect() == [(1, 0)]  # "a " are two


def check_packed(rows, ids_of, size):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    tok = bpe.encoder(P.path("byte_bpe_50k.json")).tokenizer
    ids_of = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    rows = pack(docs.repartition(3), P.path("byte_bpe_50k.json")).collect()
    assert check_packed(rows, ids_of, 2048) == 0
    assert pack(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_packer_is_bounded():
    r = random.Random(1)
    p = Packer(64, 4, 0)
    lengths = [r.randint(1, 200) for _ in range(500)]
    for n, length in enumerate(lengths):
        p.add(n, length)
        assert len(p.open) <= 4 and all(used < 64 for used, _ in p.open)
    full = {s for _, s, _ in p.out}
    p.finish()
    total = defaultdict(int)
    for (_, _, length), s, _ in p.out:
        total[s] += length
    assert sum(total.values()) == sum(lengths) and all(total[s] == 64 for s in full) and all(n & (n - 1) == 0 for n in total.values())
