from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from helpers import best_windows, near_duplicates, repeats
from sparkgrams.llm import bpe
from sparkgrams.llm.quality import fit_quality
from sparkgrams.llm.queries import table, tokenizer
from test_decontaminate import words


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        rows = {r.doc_id: r for r in out.collect()}
        texts = [(i, r.text) for i, r in before.items()]
        if name == "quality":
            assert 0.5 * len(before) < len(rows) < len(before)
        if name == "near_duplicates":
            assert set(rows) == {i for i, (_, c) in near_duplicates(texts, 5).items() if c == i}
        if name == "repeated_passages":
            exact = repeats(texts, 50)
            assert set(rows) == {i for i, (n, gone, _) in exact.items() if not gone or gone < n}
            assert all(len(r.text.encode().split()) == exact[i][0] - exact[i][1] and r.n_chars == len(r.text) for i, r in rows.items())
        if name == "benchmark_leaks":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(rows) == set(before) - {d for d, _ in best_windows(texts, items, words)}
        docs, before = spark.createDataFrame(list(rows.values()), docs.schema), rows
    held = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        held[r.doc_id] += r.length
    assert set(held) == set(before)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_packed_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    encoder = bpe.encoder(tokenizer("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        assert len(r.ids) == 4 * r.length
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    found = {i: b"".join(ids for _, ids in sorted(held)) for i, held in pieces.items()}
    assert found == {r.doc_id: encoder.ids(r.text or "") + (1).to_bytes(4, "little") for r in docs.collect()}


def test_edge_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    long = " ".join(f"w{n}" for n in range(60_000))
    some = "Each of these words is a plain one, and the sentence that they make has a sense of its own. " * 5
    odd = [(-1, None, None, None, None), (-2, "", "", "", 0), (None, some, "en", None, 1), (-3, long, None, "s", 1), (-4, some, "en", "s", 1), (-4, some, "en", "s", 1), (-5, some, "en", "s", 1)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name in ("row", "id", "rid", "score", "key", "node", "sieve_met", "DOC"):
        both = both.withColumn(name, F.lit("clash"))
    for name, step in corpus_pipeline.STAGES[1:]:
        out = step(spark, both, sf_dir)
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        if name == "packing":
            assert {r.doc_tokens for r in rows if r.doc_id in (-1, -2)} == {1}
            assert sum(r.length for r in rows if r.doc_id == -4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == -4)
            continue
        assert out.columns == docs.columns and {-1, -2, -3, None} <= set(ids) and next(r for r in rows if r.doc_id == -1).text is None
        if name == "near_duplicates":
            assert -5 in ids and -4 not in ids
        if name == "repeated_passages":
            # the smallest id keeps its passage; copies of it have no word left
            assert -5 in ids and -4 not in ids and next(r for r in rows if r.doc_id is None).text == some
    quality = corpus_pipeline.STAGES[0][1](spark, both, sf_dir)
    assert quality.columns == docs.columns and None in [r.doc_id for r in quality.collect()]


def test_empty_table_and_no_labels(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count() == 20


def test_quality_against_plain_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit_quality(docs, table(spark, sf_dir, "labels"), learn=~held, decision=0.7)
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).collect()}
    assert kept == {r.doc_id for r in docs.collect() if model.scores([(r.text or "").encode()])[0] >= 0.7}
