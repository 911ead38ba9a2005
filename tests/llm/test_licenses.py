import random
import re

import pytest
from pyspark.sql import functions as F

from sparkgrams.llm.licenses import TEMPLATES, compile_template, parse_template, scan_licenses, starts, template_pattern
from sparkgrams.llm.oracles import OP2
from sparkgrams.llm.queries import op2_license_scan


def row(spark, text):
    return scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


@pytest.mark.parametrize(
    ("text", "n_base", "first", "last", "base", "labels"),
    [
        (None, 0, None, None, "", ""),
        ("", 0, None, None, "", ""),
        ("Licensed under CC BY-NC 4.0.", 1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0"),
        ("cc by cc by; ccby cc-bye", 2, 0, 2, "cc-by", "cc-by"),
        ("x ALL rights\nreserved. General Public License", 2, 1, 4, "gpl,reserved", "gpl,reserved,reserved-notice"),
        ("This work is licensed under the GNU General Public License, version 3.", 1, 7, 7, "gpl", "gpl,gpl-3.0"),
        ("Licensed under the Apache License, Version 2.0.", 0, None, None, "", "apache-2.0"),
        ("all rights not reserved écc by", 0, None, None, "", ""),
    ],
)
def test_places_and_labels(spark, text, n_base, first, last, base, labels):
    r = row(spark, text)
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (n_base, first, last, base, labels)
    assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_automaton():
    a = compile_template("x", "<<opt>>the<</opt>> software of <<var:1-3>> is free <<opt>>now<</opt>>")
    assert (a.anchor, a.before) == (b"software of", 1)
    accept = lambda t: a.longest(t.encode().split(), 0)
    assert accept("the software of a b is free now x") == 8
    assert accept("software of a is free") == 5
    assert accept("software of is free") == -1
    assert accept("software of a b c d is free") == -1
    assert accept("software of a is not free") == -1
    assert accept("") == -1
    with pytest.raises(ValueError, match="mandatory"):
        compile_template("y", "<<opt>>a<</opt>>")


def test_nested_regions():
    a = compile_template("x", "<<opt>>the <<opt>>big <<var:0-2>><</opt>> red<</opt>> car <<opt>>of <<opt>>my<</opt>> <<opt>>own<</opt>><</opt>> now")
    assert (a.anchor, a.before) == (b"car", 5)
    accept = lambda t: a.longest(t.encode().split(), 0)
    assert accept("car now") == 2 and accept("the red car now") == 4 and accept("the big old old red car of own now") == 9
    assert accept("the big old old old red car now") == -1 and accept("the car now") == -1 and accept("car my now") == -1
    for bad in ("a <</opt>>", "<<opt>>a", "<<opt>> b", "a <<var:3-1>>", "a <<what>>"):
        with pytest.raises(ValueError, match="template y"):
            compile_template("y", bad)


def accepts(parts, words):
    """All numbers of words that the parts can take from the start."""
    ends = {0}
    for part in parts:
        if isinstance(part, str):
            ends = {e + 1 for e in ends if e < len(words) and words[e] == part}
        elif isinstance(part, tuple):
            ends = {e + n for e in ends for n in range(part[0], part[1] + 1) if e + n <= len(words)}
        else:
            ends |= {e + n for e in ends for n in accepts(part, words[e:])}
    return ends


def test_against_brute_force(spark):
    r = random.Random(6)
    templates = [("one", "<<opt>>a <<opt>>b<</opt>><</opt>> c <<var:0-2>> a"), ("two", "b c <<opt>>c<</opt>>"), ("three", "<<var:1-2>> a a <<opt>>b <<var:1-1>><</opt>>")]
    rows = [(n, " ".join(r.choice("abcd") for _ in range(r.randint(0, 14)))) for n in range(400)]
    got = {x.doc_id: x for x in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates, phrases={"a b": "ab", "b a b": "ab"}).collect()}
    for i, text in rows:
        words, spans, base = text.split(), [], []
        for phrase in (["a", "b"], ["b", "a", "b"]):
            base += [n for n in range(len(words)) if words[n : n + len(phrase)] == phrase]
        for label, markup in templates:
            at = 0
            for start in range(len(words)):
                ends = accepts(parse_template(label, markup), words[start:]) - {0}
                if start >= at and ends:
                    spans.append((label, start, max(ends)))
                    at = start + max(ends)
        row = got[i]
        assert sorted(map(tuple, row.spans)) == sorted(spans)
        assert (row.n_base, row.first_word, row.last_word) == (len(base), min(base, default=None), max(base, default=None))
        assert row.labels == ",".join(sorted({s[0] for s in spans} | ({"ab"} if base else set()))) and row.score == (1 if spans else 0.5 if base else 0)


def test_against_sql(spark, sf_dir, duck):
    got = op2_license_scan(spark, sf_dir)
    found = duck.execute(OP2)
    assert got.columns == [c[0] for c in found.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(found.fetchall(), key=str)


def test_bodies(spark):
    r = random.Random(7)

    def fill(part):
        if isinstance(part, str):
            return [part]
        if isinstance(part, tuple):
            return [f"x{n}" for n in range(r.randint(*part))]
        return [w for inner in part for w in fill(inner)] if r.random() < 0.5 else []

    for label, markup in TEMPLATES:
        words = [w for part in parse_template(label, markup) for w in fill(part)]
        found = row(spark, "x y. " + ", ".join(words).upper() + " z") if label.endswith("full") else None
        assert re.search(template_pattern(label, markup), " " + " ".join(words) + " ")
        assert compile_template(label, markup).longest([w.encode() for w in words], 0) > 0
        if found:
            assert label in found.labels.split(",") and found.score == 1
            words.remove(next(p for p in reversed(parse_template(label, markup)) if isinstance(p, str)))
            assert label not in row(spark, " ".join(words)).labels.split(",")


def test_edge_rows(spark):
    long = "word " * 200_000 + "all rights reserved. " + "word " * 1000 + "All Rights Reserved"
    df = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, "cc by"), (2, long)], "doc_id long, text string").withColumn("labels", F.lit(3)).withColumn("spans", F.lit("x"))
    out = sorted(((r.doc_id or 0, r.n_base, r.first_word, r.last_word, r.labels) for r in scan_licenses(df).collect()), key=str)
    assert out == [(0, 1, 0, 0, "cc-by"), (1, 1, 0, 0, "cc-by"), (1, 1, 0, 0, "cc-by"), (2, 2, 200_000, 201_003, "reserved,reserved-notice")]


def test_starts_overlap():
    assert starts(b" a b a b a ", b"a b a") == [0, 2]


def test_counts_match_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_base) for r in scan_licenses(docs.withColumn("score", F.lit(0))).collect()}
    for r in docs.collect():
        words = "".join(c.lower() if c.isascii() else c for c in (r.text or ""))
        words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" or ord(c) > 127 else " " for c in words).split()
        n = sum(words[i : i + len(p)] == p for p in (["cc", "by"], ["general", "public", "license"], ["all", "rights", "reserved"]) for i in range(len(words)))
        assert got[r.doc_id] == (len(words), n)
    assert scan_licenses(docs.limit(0)).count() == 0
