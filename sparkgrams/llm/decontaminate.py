"""Benchmark decontamination: SimHash over windows as long as a benchmark item,
multi-index Hamming blocks, then exact weighted-shingle similarity.

Every item has a 64-bit SimHash of its words. A text's windows of the items'
lengths are fingerprinted too, and a window is a candidate for the items of its
length whose fingerprints differ from its own in at most ``radius`` bits. These
come from an index: fingerprints are cut into four blocks of 16 bits, and of two
within the radius one block differs in at most a quarter of it, so the items that
have such a value in that block are looked up and verified; none within the
radius is missed. What a lookup costs is bounded by the ways to flip so few bits
of a block, whatever the number of items. Candidates are then verified exactly:
the sums of the smaller and of the larger counts of each shingle of five words,
divided, must reach the threshold.

Windows that can't reach it for any item of their length are not fingerprinted:
for a window and an item of n shingles each, the threshold t asks for 2tn/(1+t)
shared ones, and the positions of a text whose shingle any item has are counted
by running sums.

Texts aren't shuffled. Items go to every task in blocks of bounded size.

Words are lower-cased (A-Z) runs of letters a-z, digits and non-ASCII
characters. Items of fewer than five words are one shingle of all their words. A
text shorter than an item is one window as a whole.

Defined results: null and empty texts, and items without words, match nothing;
repeated rows are searched each, repeated items reported each; an empty table
gives an empty result; texts of any length are searched whole; other columns are
ignored. Of the windows of a row that match an item, the most similar one is
reported, then the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .licenses import SCAN
from .runtime import as_bytes, pick, session_of, slices
from .words import hashes, mix, runs

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 20
#: Words of the items that go to every task at once.
BLOCK_WORDS = 2_000_000
#: Windows that are fingerprinted at once.
WINDOWS = 4096


def fingerprints(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of the ``size`` words from each (ascending) start on: bit by
    bit the majority among the words' hashes."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        first = int(starts[done])
        some = int(np.searchsorted(starts, first + WINDOWS))
        part = mix(h[first : int(starts[some - 1]) + size])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=ones[1:])
        at = starts[done:some] - first
        out[done:some] = np.packbits(2 * (ones[at + size] - ones[at]) > size, axis=1, bitorder="little").view(np.uint64)[:, 0]
        done = some
    return out


def simhash(h: np.ndarray) -> np.uint64:
    return fingerprints(h, np.zeros(1, np.int64), len(h))[0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller over sum of larger counts."""
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca = np.bincount(place[: len(a)], minlength=len(values))
    cb = np.bincount(place[len(a) :], minlength=len(values))
    return float(np.minimum(ca, cb).sum() / np.maximum(ca, cb).sum())


class HammingBlocks:
    """Fingerprints by the values of their four blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.flips = prints, radius, radius // 4
        self.blocks = []
        for values in prints.view(np.uint16).reshape(-1, 4).T:
            order = np.argsort(values, kind="stable")
            present, first = np.unique(values[order], return_index=True)
            self.blocks.append((order, present, np.append(first, len(order))))

    def within(self, fingerprint: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints within the radius, and their distances."""
        found = []
        for own, (order, present, first) in zip(np.array([fingerprint]).view(np.uint16), self.blocks, strict=True):
            masks = _masks(self.flips)
            if len(masks) < len(present):
                values = masks ^ own
                at = np.searchsorted(present, values)
                at = at[present[np.minimum(at, len(present) - 1)] == values]
            else:
                at = np.flatnonzero(np.bitwise_count(present ^ own) <= self.flips)
            found += [order[first[i] : first[i + 1]] for i in at.tolist()]
        met = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        apart = np.bitwise_count(self.prints[met] ^ fingerprint)
        return met[apart <= self.radius], apart[apart <= self.radius]


    def pairs(self, fingerprints: np.ndarray) -> list[tuple[int, int, int]]:
        """(which one, fingerprint of the index, distance) within the radius."""
        if len(self.prints) > SMALL:
            return [(n, int(i), int(d)) for n, f in enumerate(fingerprints) for i, d in zip(*self.within(f), strict=True)]
        # few values in each block: all are compared at once
        apart = np.bitwise_count(fingerprints.view(np.uint16).reshape(-1, 1, 4) ^ self.prints.view(np.uint16).reshape(1, -1, 4))
        total = apart.sum(axis=2)
        which, met = np.nonzero((apart <= self.flips).any(axis=2) & (total <= self.radius))
        return list(zip(which.tolist(), met.tolist(), total[which, met].tolist(), strict=True))


#: Fingerprints of one length up to which all values of a block are compared.
SMALL = 64
_by_flips: dict[int, np.ndarray] = {}


def _masks(flips: int) -> np.ndarray:
    """All values of 16 bits of which at most ``flips`` are set."""
    if flips not in _by_flips:
        _by_flips[flips] = np.array([sum(1 << b for b in c) for n in range(min(flips, 16) + 1) for c in combinations(range(16), n)], np.uint16)
    return _by_flips[flips]


class Items:
    """A block of items: by length the index of their fingerprints, by shingle
    size the shingles that any of them has."""

    def __init__(self, ids: list, words: list[np.ndarray], threshold: float, radius: int):
        self.ids, self.threshold = ids, threshold
        size = np.array([len(w) for w in words])
        self.shingles = [runs(w, min(SHINGLE, len(w))) for w in words]
        #: Length in words: shingle size, items, index.
        self.lengths: dict[int, tuple[int, np.ndarray, HammingBlocks]] = {}
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in np.unique(size).tolist():
            mine = np.flatnonzero(size == length)
            self.lengths[length] = min(SHINGLE, length), mine, HammingBlocks(np.array([simhash(words[i]) for i in mine], np.uint64), radius)
        for gram in {g for g, _, _ in self.lengths.values()}:
            keys = np.unique(np.concatenate([s for s, w in zip(self.shingles, size, strict=True) if min(SHINGLE, w) == gram]))
            met = np.zeros(1 << 20, dtype=bool)
            met[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.known[gram] = keys, met

    def least(self, size: int, length: int, gram: int) -> float:
        """Shingles that a window of ``size`` words has to share with an item."""
        return self.threshold / (1 + self.threshold) * (size + length - 2 * gram + 2) - 1e-9

    def search(self, words: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
        """By item: similarity, start, words and bits apart of the best window."""
        best: dict[int, tuple[float, int, int, int]] = {}
        for gram, (keys, met) in self.known.items():
            shingles = runs(words, gram)
            if not len(shingles):
                continue
            at = np.flatnonzero(met[(shingles >> np.uint64(44)).astype(np.int64)])
            place = np.searchsorted(keys, shingles[at])
            at = at[keys[np.minimum(place, len(keys) - 1)] == shingles[at]]
            if not len(at):
                continue
            held = np.zeros(len(shingles) + 1, np.int64)
            held[at + 1] = 1
            held = np.cumsum(held)
            for length, (g, items, index) in self.lengths.items():
                size = min(length, len(words))
                least = self.least(size, length, gram)
                span = size - gram + 1
                if g != gram or len(at) < least or span < least:
                    continue
                starts = np.flatnonzero(held[span:] - held[:-span] >= least)
                if not len(starts):
                    continue
                for n, item, apart in index.pairs(fingerprints(words, starts, size)):
                    start, item = int(starts[n]), int(items[item])
                    alike = similarity(shingles[start : start + span], self.shingles[item])
                    if alike >= self.threshold and (item not in best or alike > best[item][0]):
                        best[item] = alike, start, size, apart
        return best


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, words, held = [], [], 0
    for row in pick(benchmark, id_col, text_col).toLocalIterator():
        h = hashes((row[1] or "").encode().translate(SCAN).split())
        if not len(h):
            continue
        if ids and held + len(h) > limit:
            yield ids, words
            ids, words, held = [], [], 0
        ids.append(row[0])
        words.append(h)
        held += len(h)
    if ids:
        yield ids, words


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row for each document and item that it contains:
    ``id_col, item_col, start, n_words, similarity, hamming``, where the words
    ``start .. start + n_words`` of the text are the most similar window."""
    spark = session_of(docs)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, {item_col} {dict(benchmark.dtypes)[item_col]}, start long, n_words long, similarity double, hamming int"
    names = [id_col, item_col, "start", "n_words", "similarity", "hamming"]
    found = None
    texts = pick(docs, id_col, text_col)
    for ids, words in item_blocks(benchmark, item_col, item_text_col, block_words):
        shared = spark.sparkContext.broadcast(Items(ids, words, threshold, radius))
        part = texts.mapInArrow(_search(shared, id_col, text_col, names), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _search(shared, id_col: str, text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        item_type = pa.array(items.ids).type
        for batch in slices(batches, text_col):
            rows = []
            for row, raw in enumerate(as_bytes(batch.column(text_col))):
                found = items.search(hashes(raw.translate(SCAN).split()))
                rows += [(row, items.ids[item], start, size, alike, apart) for item, (alike, start, size, apart) in found.items()]
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [item_type, pa.int64(), pa.int64(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).take(pa.array(columns[0])), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names
                )

    return run
