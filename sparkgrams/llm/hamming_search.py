"""Exact top-k search among binary codes by incremental multi-index hashing.

A vector's code has one bit for each component, set where it is positive. Codes
are cut into m segments, and an index holds each code under each of its segments'
values. A query grows its search radius: in step (r, s) it looks up, in segment
s, the values that differ from its own in exactly r bits, and the codes found are
verified by their full distance. A code that has not been met after step (r, s)
differs in more than r bits in the segments up to s and in r or more in the
others, so in more than ``m * r + s`` bits. The query is done when its kth verified
distance is no larger than that. Values are looked up by flipping bits, or, once
there are more ways to flip than values in the index, by comparing those values;
both find the same.

Every task builds the index of its share of the codes (``SHARD`` at a time) and
answers a block of queries from it; of each share's first k the first k of all
are taken. No share has to look farther than the kth distance among a sample of
all codes, which is found first, by the same search: that bounds the radius
alone, whatever the sample.

Rows with equal codes are one entry of the index, with the ids that can be among
its first k: a hot code costs no more than any other.

Defined results: rows with a null or empty vector, or a null id, are neither
found nor do they search; null components count as not positive; vectors of
unequal length are compared up to the longest one's bits, missing ones unset; a
row isn't its own neighbour (neither are other rows of its id), but its copies
are; ties in distance go to smaller ids; with fewer than k other rows all of them
are returned, however far; an empty table gives an empty result; of a repeated id
every row can be found, and of query rows that repeat an id the one of the least
code searches; ids may be of any type; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, pick, session_of

#: Bits of a code's word; longer codes are several words.
WORD = 64
#: Codes that one index holds, at most.
SHARD = 1 << 20
#: Codes among which a first bound of the kth distance is found.
SAMPLE = 1 << 14
#: Queries that go to every task at once.
QUERY_BLOCK = 1 << 16


def code_of(vector: Column, bits: int) -> Column:
    """The sign bits as an array of 64-bit words."""
    words = []
    for start in range(0, bits, WORD):
        part = F.slice(vector, start + 1, min(WORD, bits - start))
        ones = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(ones, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return F.array(*words)


@lru_cache(maxsize=None)
def flips(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits of which ``radius`` are set."""
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(width), radius)], dtype=np.uint64)


class MultiIndex:
    """The codes (rows of 64-bit words) by the values of their segments;
    ``counts`` are the rows that each code stands for."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, bits: int, width: int | None = None):
        self.words, self.counts, self.bits = words, counts, bits
        # so wide that a value has about one code
        width = width or max(4, min(16, round(log2(max(len(words), 2)))))
        self.segments = []
        for word in range(words.shape[1]):
            held = min(WORD, bits - WORD * word)
            parts = -(-held // width)
            edges = [held * n // parts for n in range(parts + 1)]
            for start, end in zip(edges, edges[1:], strict=False):
                value = self._value(words[:, word], start, end - start)
                order = np.argsort(value, kind="stable")
                present, first = np.unique(value[order], return_index=True)
                self.segments.append((word, start, end - start, order, present, np.append(first, len(order))))

    @staticmethod
    def _value(word, start: int, width: int):
        return (word >> np.uint64(start)) & np.uint64((1 << width) - 1)

    def shell(self, code: np.ndarray, segment: int, radius: int) -> np.ndarray:
        """The codes whose segment differs in exactly ``radius`` bits."""
        word, start, width, order, present, first = self.segments[segment]
        if radius > width:
            return np.empty(0, np.int64)
        own = self._value(code[word], start, width)
        if comb(width, radius) < len(present):
            values = flips(width, radius) ^ own
            at = np.searchsorted(present, values)
            at = at[present[np.minimum(at, len(present) - 1)] == values]
        else:
            at = np.flatnonzero(np.bitwise_count(present ^ own) == radius)
        count = first[at + 1] - first[at]
        return order[np.repeat(first[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]

    def nearest(self, code: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Codes and distances that hold the nearest k rows, beside the query's
        own, of those within ``bound``, and the last radius."""
        met, apart, m = np.empty(0, np.int64), np.empty(0, np.int64), len(self.segments)
        radius = 0
        for radius in range(max((s[2] for s in self.segments), default=-1) + 1):
            for segment in range(m):
                new = np.setdiff1d(self.shell(code, segment, radius), met)
                if len(new):
                    d = np.bitwise_count(self.words[new] ^ code).sum(axis=1, dtype=np.int64)
                    met, apart = np.append(met, new), np.append(apart, d)
                    by = np.argsort(apart, kind="stable")
                    # its own row may be among those of its code
                    rows = np.cumsum(self.counts[met[by]] - (apart[by] == 0))
                    last = np.searchsorted(rows, k)
                    if last < len(by):
                        bound = min(bound, int(apart[by[last]]))
                if m * radius + segment >= bound:
                    return met[apart <= bound], apart[apart <= bound], radius
        return met[apart <= bound], apart[apart <= bound], radius


def _matrix(column, words: int) -> np.ndarray:
    flat = np.array(column.to_pylist(), dtype=np.int64) if len(column) else np.empty(0, np.int64)
    return flat.reshape(-1, words).view(np.uint64)


def _bounds(index: MultiIndex, k: int, words: int):
    """Per query an upper bound of its kth distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for code in _matrix(batch.column("code"), words):
                found, apart, _ = index.nearest(code, k, index.bits)
                by = np.argsort(apart, kind="stable")
                rows = np.cumsum(index.counts[found[by]] - (apart[by] == 0))
                last = np.searchsorted(rows, k)
                out.append(int(apart[by[last]]) if last < len(by) else index.bits)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("code"), pa.array(out, pa.int32())], ["qid", "code", "bound"])

    return run


def _answers(block, k: int, words: int, bits: int, width: int | None, kinds: tuple):
    """The queries' nearest rows in each share of the codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qcodes, bounds = block.value

        def answer(codes: np.ndarray, ids: list[list]) -> pa.RecordBatch | None:
            index = MultiIndex(codes, np.array(list(map(len, ids)), np.int64), bits, width)
            rows = []
            for qid, code, bound in zip(qids, qcodes, bounds, strict=True):
                found, apart, _ = index.nearest(code, k, bound)
                near = sorted((d, i) for d, at in zip(apart.tolist(), found.tolist(), strict=True) for i in ids[at] if i != qid)
                rows += [(qid, d, i) for d, i in near[:k]]
            if not rows:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["qid", "d", "id"])

        codes: list[np.ndarray] = []
        ids: list[list] = []
        for batch in batches:
            codes.append(_matrix(batch.column("code"), words))
            ids += batch.column("ids").to_pylist()
            if len(ids) >= SHARD:
                out, codes, ids = answer(np.concatenate(codes), ids), [], []
                if out is not None:
                    yield out
        if ids:
            out = answer(np.concatenate(codes), ids)
            if out is not None:
                yield out

    return run


def search_codes(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    width: int | None = None,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k nearest rows of ``vectors`` for each row of ``queries``, by Hamming
    distance of their codes.

    Returns ``query_id, rank, neighbor_id, distance``. ``width`` is a segment's
    bits, by default about the binary logarithm of the number of codes in an
    index; ``query_block`` bounds the queries that go to every task at once.
    """
    spark = session_of(vectors)
    rows = pick(vectors, id_col, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id is not null and size(v) > 0")
    asked = pick(queries, id_col, vector_col).select(F.col(id_col).alias("qid"), F.col(vector_col).alias("v")).filter("qid is not null and size(v) > 0")
    bits = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    words = -(-bits // WORD)
    kind, asked_kind = dict(rows.dtypes)["id"], dict(asked.dtypes)["qid"]
    coded = rows.select("id", code_of(F.col("v"), bits).alias("code"))
    # one more than k: a query's own row may be among the first
    codes = materialize(_first(coded, "code", ["id"], k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    asked = asked.select("qid", code_of(F.col("v"), bits).alias("code")).groupBy("qid").agg(F.min("code").alias("code"))

    some = codes.select("code", F.size("ids").cast("long").alias("c")).orderBy(F.xxhash64("code")).limit(SAMPLE).toArrow()
    sample = spark.sparkContext.broadcast(MultiIndex(_matrix(some.column("code"), words), some.column("c").to_numpy(), bits, width))
    asked = materialize(asked.mapInArrow(lambda batches: _bounds(sample.value, k, words)(batches), f"qid {asked_kind}, code array<long>, bound int"), "asked")

    found = None
    for qids, qcodes, bounds in _blocks(asked, words, query_block):
        block = spark.sparkContext.broadcast((qids, qcodes, bounds))
        part = codes.mapInArrow(_answers(block, k, words, bits, width, (_arrow(asked, "qid"), pa.int32(), _arrow(rows, "id"))), f"qid {asked_kind}, d int, id {kind}")
        # a block's answers don't wait for the others' in the driver's memory
        part = part if len(qids) < query_block else materialize(_first(part, "qid", ["d", "id"], k), "answers")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id {asked_kind}, rank int, neighbor_id {kind}, distance int")
    order = Window.partitionBy("qid").orderBy("d", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("neighbor_id"), F.col("d").alias("distance"))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _blocks(asked: DataFrame, words: int, size: int) -> Iterator[tuple[list, np.ndarray, list[int]]]:
    """The queries, a block at a time."""
    held: list = []
    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield [r.qid for r in held], np.array([r.code for r in held], np.int64).view(np.uint64), [r.bound for r in held]
            held = []
    if held:
        yield [r.qid for r in held], np.array([r.code for r in held], np.int64).view(np.uint64), [r.bound for r in held]


def _first(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; every task hands on at most n of one."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("n") <= n).drop("n")
