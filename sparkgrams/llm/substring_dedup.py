"""Substring dedup: prefix-partitioned suffix trees over words.

A window of ``window`` words is a repeat where its words also stand in a document
of a smaller id. The suffixes that can begin a repeat are dealt to groups that
fit in memory by a prefix of variable length, and each group's suffix tree is
built alone: below an internal node of depth ``window`` or more stand suffixes
that share so many words, so all but those of the node's smallest id are repeats,
as far as the node is deep.

How suffixes are dealt. A window has, for each prefix length, an anchor: its run
of so many words with the least hash. Equal windows have equal anchors, and
neighbouring windows mostly share theirs, so they travel as one stretch of words
instead of one by one. Prefixes begin with a third of the window. An anchor that
no other document has begins no group.

Hot passages. Whole copies of a document are folded into the smallest id first,
then whole passages: neighbouring stretches, parted where an anchor's hash says so,
are one passage, and of equal passages only those of the smallest id go on. In each
group stretches of equal words are one class: what is true of the class's
smallest id is found once, and all its other members are repeats as a whole. A
group that still has more than ``group_limit`` classes is dealt again by a longer
prefix (halfway to the window, and so on); stretches that only share the shorter
one drop out there. At the window's full length a class is a node of the tree.
So the limit bounds a group's memory, and a passage in a third of all documents
costs each of them a few rows on each length, whatever its length or number.

Words are ``[^\\x20\\x09-\\x0D]+`` and compared by 64-bit hashes, all words of a
window; stretches are equal if 128-bit hashes of them are.

Defined results: a null or empty text has no words; texts shorter than the
window keep every word; repeated rows of one id, and rows that share an id but
not a text, take nothing from each other; rows with a null id are kept whole and
remove nothing elsewhere; an empty table gives an empty result; other columns are
ignored (or passed through by ``remove_repeats``). Texts of any length are read
whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import as_bytes, materialize, pick, session_of, sieve, slices
from .words import hashes, runs, window_min

WINDOW = 50
#: Classes of stretches in a group, at most: some 250,000 words, 2 MB.
GROUP_LIMIT = 4000
#: Words of the groups whose trees are built at once.
TREE_WORDS = 1 << 20
#: Windows of one document anchored at once.
BLOCK = 1 << 22
#: Bits of an anchor's hash of which one is set where a passage goes on.
PASSAGE = 3
#: Rows that go on to Spark at once.
ROWS = 10_000

_ANCHORS = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))


def prefix_lengths(window: int) -> list[int]:
    """Anchors' lengths, each halfway from the one before to the window."""
    out = [max(1, window // 3)]
    while window - out[-1] > window // 8:
        out.append((out[-1] + window + 1) // 2)
    return [*out, window] if out[-1] < window else out


def anchors(h: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per run of neighbouring windows with one anchor of ``size`` words: the
    anchor's hash, the first window's start and how many they are."""
    keys, ats, ns = [], [], []
    for base in range(0, max(len(h) - window + 1, 0), BLOCK):
        part = h[base : base + BLOCK + window - 1]
        g = runs(part, size)
        # equal hashes are told apart by place, so the first one is the anchor
        order = (g & ~np.uint64(0xFFFFFF)) | np.arange(len(g), dtype=np.uint64)
        place = (window_min(order, window - size + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        keys.append(g[place[first]])
        ats.append(base + first)
        ns.append(np.diff(np.append(first, len(place))))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(ats), np.concatenate(ns)


class SuffixTree:
    """The suffixes of many stretches of words, sorted, with the number of words
    that neighbours share: its internal nodes are the intervals of suffixes that
    share more words than those around them.

    ``symbols`` holds the stretches one after the other, ``lengths`` theirs.
    Suffixes are named level by level, by twice as many words each time; those
    names order them and tell what they share.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, starts: np.ndarray):
        ends = np.cumsum(lengths)
        # an end of its own behind each stretch: no suffix reaches into the next
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + len(lengths)
        rank = np.insert(rank, ends, np.arange(len(lengths)))
        starts = starts + np.repeat(np.arange(len(lengths)), lengths)[starts]
        names, size = [rank], 1
        while size < lengths.max(initial=1) + 1:
            after = np.append(rank[size:], np.full(min(size, len(rank)), -1)) + 1
            rank = np.unique(rank * (int(rank.max()) + 2) + after[: len(rank)], return_inverse=True)[1].astype(np.int64)
            names.append(rank)
            size *= 2
        self.order = np.argsort(rank[starts], kind="stable")
        place = starts[self.order]
        self.shared = np.zeros(len(place), np.int64)  # with the suffix before
        for level in range(len(names) - 1, -1, -1):
            a, b = place[:-1] + self.shared[1:], place[1:] + self.shared[1:]
            inside = (a < len(rank)) & (b < len(rank))
            same = np.zeros(len(a), bool)
            same[inside] = names[level][a[inside]] == names[level][b[inside]]
            self.shared[1:] += same << level

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix, in sorted order, the number of its highest node of
        at least ``depth`` words (alone in one, it is a leaf); per node the words
        that all its suffixes share (of a leaf: 0)."""
        new = self.shared < depth
        new[:1] = True
        node = np.cumsum(new) - 1
        deep = np.zeros(int(new.sum()), np.int64)
        inner = np.flatnonzero(~new)
        if len(inner):
            deep += np.iinfo(np.int64).max
            np.minimum.at(deep, node[inner], self.shared[inner])
            deep[deep == np.iinfo(np.int64).max] = 0
        return node, deep


def _profile(window: int):
    """Per row: its words' number, digest and anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = prefix_lengths(window)[0]
        for batch in slices(batches, "text"):
            counts, digests, offsets, parts = [], [], [0], []
            for raw in as_bytes(batch.column("text")):
                words = raw.split()
                counts.append(len(words))
                digests.append(sha256(b" ".join(words)).digest())
                if len(words) >= window:
                    parts.append(anchors(hashes(words), window, size))
                    offsets.append(offsets[-1] + len(parts[-1][0]))
                else:
                    offsets.append(offsets[-1])
            key, at, n = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0), np.empty(0))
            flat = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], fields=list(_ANCHORS))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rid"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], ["id", "rid", "n_words", "digest", "anchors"]
            )

    return run


#: A stretch: its group, its words' hash, its document, what it was cut from (a
#: row or a stretch), where there it begins, and its windows.
_STRETCH = "key long, d1 long, d2 long, id {kind}, o1 long, o2 long, at int, n int"
_CLASS = ["key", "d1", "d2"]
_PLACE = ["id", "o1", "o2", "at"]


def _digest(words: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(words.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _rows(rows: list[tuple], kind: pa.DataType, words: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [kind] + [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.binary()] * words
    names = [*_CLASS, *_PLACE, "n", *["words"] * words]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _passages(window: int):
    """A document's neighbouring stretches that others may share, put together
    as far as anchors allow that others have as well: passages, with their
    stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kind, rows = batch.column("id").type, []
            meta = zip(batch.column("id").to_pylist(), batch.column("rid").to_pylist(), batch.column("runs").to_pylist(), as_bytes(batch.column("text")), strict=True)
            for ident, rid, found, raw in meta:
                h = hashes(raw.split())
                end, held = -1, []
                for r in sorted(found, key=lambda r: r["at"]):
                    if held and (r["at"] != end or not r["key"] & PASSAGE):
                        rows.append(_passage(h, held, ident, rid, end, window))
                        held = []
                    end = r["at"] + r["n"]
                    held.append((r["key"], *_digest(h[r["at"] : end + window - 1]), r["at"], r["n"]))
                if held:
                    rows.append(_passage(h, held, ident, rid, end, window))
                if len(rows) > ROWS:
                    yield _passage_rows(rows, kind)
                    rows = []
            if rows:
                yield _passage_rows(rows, kind)

    return run


def _passage(h: np.ndarray, held: list[tuple], ident, rid: int, end: int, window: int) -> tuple:
    at = held[0][3]
    return (*_digest(h[at : end + window - 1]), ident, rid, at, end - at, held)


def _passage_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    *columns, runs = zip(*rows, strict=True)
    kinds = [pa.int64(), pa.int64(), kind, pa.int64(), pa.int32(), pa.int32()]
    flat = list(zip(*[r for held in runs for r in held], strict=True))
    inner = [pa.array(c, k) for c, k in zip(flat, [pa.int64()] * 3 + [pa.int32()] * 2, strict=True)]
    offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(inner, names=["key", "d1", "d2", "at", "n"]))
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), lists], ["d1", "d2", "id", "rid", "at", "n", "runs"])


def _words(window: int):
    """The words of the stretches asked for, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_CLASS, "id", "large", "words"]
        for batch in slices(batches, "text"):
            kinds, rows = [pa.int64()] * 3 + [batch.column("id").type, pa.bool_(), pa.binary()], []
            meta = zip(batch.column("id").to_pylist(), batch.column("runs").to_pylist(), as_bytes(batch.column("text")), strict=True)
            for ident, found, raw in meta:
                h = hashes(raw.split())
                rows += [(r["key"], r["d1"], r["d2"], ident, r["large"], h[r["at"] : r["at"] + r["n"] + window - 1].tobytes()) for r in found]
                if len(rows) > ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _split(window: int, size: int):
    """Stretches of classes, cut by anchors of a longer prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rows = batch.column("id").type, []
            for d1, d2, ident, words in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "id", "words")), strict=True):
                h = np.frombuffer(words, np.uint64)
                keys, ats, ns = anchors(h, window, size)
                for key, at, n in zip(keys.view(np.int64).tolist(), ats.tolist(), ns.tolist(), strict=True):
                    part = h[at : at + n + window - 1]
                    rows.append((key, *_digest(part), ident, d1, d2, at, n, part.tobytes()))
                if len(rows) > ROWS:
                    yield _rows(rows, kind, True)
                    rows = []
            if rows:
                yield _rows(rows, kind, True)

    return run


def _trees(window: int, tree_words: int):
    """Rows sorted by key: builds the trees of whole groups, some at a time, and
    gives the runs of repeats of each stretch."""

    def solve(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch | None:
        lengths = np.array([len(r[4]) // 8 for r in rows])
        counts = lengths - window + 1
        symbols = np.frombuffer(b"".join(r[4] for r in rows), np.uint64)
        owner = np.repeat(np.arange(len(rows)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        tree = SuffixTree(symbols, lengths, (np.cumsum(lengths) - lengths)[owner] + inside)
        node, deep = tree.nodes(window)
        ids = np.array([r[3] for r in rows])[owner][tree.order]
        by_id = np.lexsort((ids, node))
        least = ids[by_id][np.searchsorted(node[by_id], np.arange(len(deep)))][node]
        repeat = np.empty(len(owner), bool)
        repeat[tree.order] = (ids > least) & (deep[node] >= window)
        # neighbouring repeats of one stretch are one run
        edge = np.flatnonzero(repeat & ~(np.append(False, repeat[:-1]) & np.append(False, owner[1:] == owner[:-1])))
        if not len(edge):
            return None
        total = np.append(np.cumsum(repeat), repeat.sum())
        n = np.append(total[edge[1:] - 1], total[-1]) - (total[edge] - 1)
        of = owner[edge].tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[o][1] for o in of], pa.int64()), pa.array([rows[o][2] for o in of], pa.int64()), pa.array([rows[o][3] for o in of], kind), pa.array(inside[edge].astype(np.int32)), pa.array(n.astype(np.int32))],
            ["d1", "d2", "id", "run_at", "run_n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, kind = 0, None
        for batch in batches:
            kind = batch.column("id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "d1", "d2", "id", "words")), strict=True):
                if size >= tree_words and row[0] != held[-1][0]:
                    found = solve(held, kind)
                    if found is not None:
                        yield found
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) // 8
        if held:
            found = solve(held, kind)
            if found is not None:
                yield found

    return run


def _solve(stretches: DataFrame, words_of: Callable[[DataFrame], DataFrame], kind: str, window: int, sizes: list[int], group_limit: int) -> DataFrame:
    """Runs of repeated windows (o1, o2, id, at, n) of what the stretches (a
    written table) were cut from. ``words_of`` gives the words of classes, and
    ``sizes`` are the prefix lengths from that of the stretches on. Only what has
    a partner is joined: most stretches are alone."""
    first = F.min(F.struct(*_PLACE, "n")).alias("f")
    classes = materialize(stretches.groupBy(*_CLASS).agg(first, F.count("*").alias("c")).select(*_CLASS, "f.*", "c"), "classes")
    several = classes.filter("c > 1").select(*_CLASS, F.col("id").alias("least"))
    copies = sieve(stretches, several, "d1").join(several, _CLASS).filter("id > least").select("o1", "o2", "id", "at", "n")
    if len(sizes) == 1:
        return copies  # a class is a node of the tree: its smallest id repeats nothing
    groups = classes.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).filter("lo < hi")
    groups = materialize(groups.select("key", (F.col("c") > group_limit).alias("large")), "groups")
    large = not groups.filter("large").isEmpty()
    mixed = words_of(sieve(classes, groups, "key").join(groups, "key").drop("c"))
    mixed = materialize(mixed, "mixed") if large else mixed
    fit = mixed.filter("not large").select(*_CLASS, "id", "words").repartition("key").sortWithinPartitions("key")
    found = fit.mapInArrow(_trees(window, TREE_WORDS), f"d1 long, d2 long, id {kind}, run_at int, run_n int")
    if large:
        deeper = mixed.filter("large").select("d1", "d2", "id", "words").mapInArrow(_split(window, sizes[1]), f"{_STRETCH.format(kind=kind)}, words binary")
        deeper = materialize(deeper, "stretches")

        def of_deeper(wanted: DataFrame) -> DataFrame:
            return deeper.drop("n").join(wanted.drop("n"), [*_CLASS, *_PLACE]).select(*_CLASS, "id", "large", "words")

        below = _solve(deeper.drop("words"), of_deeper, kind, window, sizes[1:], group_limit)
        found = found.unionByName(below.select(F.col("o1").alias("d1"), F.col("o2").alias("d2"), "id", F.col("at").alias("run_at"), F.col("n").alias("run_n")))
    found = materialize(found, "found")
    firsts = sieve(stretches, found.select("d1").distinct(), "d1").join(found, ["d1", "d2", "id"])
    return copies.unionByName(firsts.select("o1", "o2", "id", (F.col("at") + F.col("run_at")).alias("at"), F.col("run_n").alias("n")))


def find_repeats(docs: DataFrame, *, window: int = WINDOW, group_limit: int = GROUP_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id, rid, n_words, digest, whole, repeats``.

    ``rid`` tells rows of one id apart by their text; ``digest`` is the words'
    SHA-256, joined by one space; ``whole`` is true where all words also stand, in
    order, as the whole of a document of a smaller id; else ``repeats`` lists runs
    of repeated windows as first window and number, or is null. Runs may touch or
    overlap.
    """
    session_of(docs)
    kind = dict(docs.dtypes)[id_col]
    texts = _texts(docs, id_col, text_col)
    profile = materialize(texts.mapInArrow(_profile(window), f"id {kind}, rid long, n_words long, digest binary, anchors array<struct<key:long,at:int,n:int>>"), "profile")
    named = profile.filter(F.col("id").isNotNull() & (F.col("n_words") >= window))
    firsts = named.groupBy("digest").agg(F.min(F.struct("id", "rid")).alias("f"))
    firsts = materialize(firsts.select("digest", F.col("f.id").alias("least"), F.col("f.rid").alias("least_rid")), "firsts")
    judged = named.join(firsts, "digest")
    own = judged.filter("id = least and rid = least_rid").dropDuplicates(["id", "rid"]).select("id", "rid", F.inline("anchors"))
    own = materialize(own, "anchors")
    met = own.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    met = materialize(met, "met")
    wanted = sieve(own, met, "key").join(met, "key").groupBy("id", "rid").agg(F.collect_list(F.struct("key", "at", "n")).alias("runs"))
    wanted = materialize(wanted, "wanted")
    sought = sieve(texts, wanted, "rid").dropDuplicates(["id", "rid"]).join(wanted, ["id", "rid"])
    run = "array<struct<key:long,d1:long,d2:long,at:int,n:int>>"
    passages = materialize(sought.mapInArrow(_passages(window), f"d1 long, d2 long, id {kind}, rid long, at int, n int, runs {run}"), "passages")
    several = passages.groupBy("d1", "d2").agg(F.min("id").alias("least"), F.count("*").alias("c")).filter("c > 1").drop("c")
    several = materialize(several, "several")
    marked = sieve(passages, several, "d1", split=True)
    judged = materialize(marked.filter("sieve_met").drop("sieve_met").join(several, ["d1", "d2"], "left"), "judged")
    copies = judged.filter("id > least").select(F.col("rid").alias("o1"), F.lit(0).cast("long").alias("o2"), "id", "at", "n")
    others = marked.filter("not sieve_met").select("id", "rid", "runs").unionByName(judged.filter("least is null or id = least").select("id", "rid", "runs"))
    others = others.select("id", F.col("rid").alias("o1"), F.lit(0).cast("long").alias("o2"), F.inline("runs"))
    stretches = materialize(others.select(*_CLASS, *_PLACE, "n"), "stretches")

    def of_texts(mixed: DataFrame) -> DataFrame:
        asked = mixed.groupBy("id", F.col("o1").alias("rid")).agg(F.collect_list(F.struct(*_CLASS, "at", "n", "large")).alias("runs"))
        asked = materialize(asked, "asked")
        held = sieve(texts, asked, "rid").dropDuplicates(["id", "rid"]).join(asked, ["id", "rid"])
        return held.mapInArrow(_words(window), f"key long, d1 long, d2 long, id {kind}, large boolean, words binary")

    found = copies.unionByName(_solve(stretches, of_texts, kind, window, prefix_lengths(window), group_limit))
    repeats = found.groupBy("id", F.col("o1").alias("rid")).agg(F.collect_list(F.struct("at", "n")).alias("repeats"))
    small = profile.select("id", "rid", "n_words", "digest").join(firsts.select("digest", "least"), "digest", "left")
    return (
        small.withColumn("whole", F.coalesce(F.col("least") < F.col("id"), F.lit(False)))
        .join(repeats, ["id", "rid"], "left")
        .select("id", "rid", "n_words", "digest", "whole", "repeats")
    )


def _rid(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), _rid(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))


def _covered(n_words: int, repeats: list[dict], window: int) -> np.ndarray:
    """Which words stand in a repeated window."""
    edge = np.zeros(n_words + 1, np.int64)
    for r in repeats:
        edge[r["at"]] += 1
        edge[r["at"] + r["n"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def _cut(window: int, text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            removed, digests, spans, texts = [], [], [], []
            for raw, repeats in zip(as_bytes(batch.column("text")), batch.column("repeats").to_pylist(), strict=True):
                words = raw.split()
                gone = _covered(len(words), repeats, window)
                joined = b" ".join([words[i] for i in np.flatnonzero(~gone)])
                removed.append(int(gone.sum()))
                digests.append(sha256(joined).hexdigest())
                cuts = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
                spans.append([{"start": a, "words": b - a} for a, b in cuts.tolist()])
                texts.append(joined.decode() if text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rid"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, _SPANS), pa.array(texts, pa.string())],
                ["id", "rid", "n_removed", "kept_sha256", "removed", "kept"],
            )

    return run


def _parts(docs: DataFrame, found: DataFrame, window: int, text: bool, id_col: str, text_col: str) -> DataFrame:
    """The rows of which a part goes, once for each id and text: only their texts
    are read again."""
    kind = dict(docs.dtypes)[id_col]
    partly = materialize(found.filter("not whole and repeats is not null").select("id", "rid", "repeats").dropDuplicates(["id", "rid"]), "partly")
    texts = sieve(_texts(docs, id_col, text_col), partly, "rid").dropDuplicates(["id", "rid"]).join(partly, ["id", "rid"])
    return texts.mapInArrow(_cut(window, text), f"id {kind}, rid long, n_removed long, kept_sha256 string, removed array<struct<start:long,words:long>>, kept string")


def cut_repeats(docs: DataFrame, *, window: int = WINDOW, group_limit: int = GROUP_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col, n_words, n_removed, kept_sha256`` (of the kept words,
    joined by one space) and ``removed``, the spans of removed words as start and
    number."""
    found = materialize(find_repeats(docs, window=window, group_limit=group_limit, id_col=id_col, text_col=text_col), "repeats")
    parts = _parts(docs, found, window, False, id_col, text_col).drop("kept")
    out = found.select("id", "rid", "n_words", "digest", "whole").join(parts, ["id", "rid"], "left")
    some, none = F.col("n_removed").isNotNull(), F.array().cast("array<struct<start:long,words:long>>")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("words")))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).when(some, F.col("n_removed")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(F.col("whole"), F.lit(sha256(b"").hexdigest())).when(some, F.col("kept_sha256")).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
        F.when(F.col("whole"), everything).when(some, F.col("removed")).otherwise(none).alias("removed"),
    )


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, group_limit: int = GROUP_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated windows cut out of their texts (the kept words
    joined by one space); documents of which no word is left go. Texts without
    repeats, and other columns, stay as they are."""
    found = materialize(find_repeats(docs, window=window, group_limit=group_limit, id_col=id_col, text_col=text_col), "repeats")
    parts = _parts(docs, found, window, True, id_col, text_col).select("id", "rid", "kept")
    gone = found.filter("whole").select("id", "rid", F.lit("").alias("kept")).dropDuplicates(["id", "rid"])
    decided = materialize(parts.unionByName(gone), "decided")
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), _rid(id_col, text_col).alias("rid"))
    marked = sieve(named, decided, "rid", split=True)
    joined = marked.filter("sieve_met").drop("sieve_met").join(decided, ["id", "rid"], "left").filter("kept is null or kept <> ''")
    changed = joined.select(*[F.coalesce("kept", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
    return marked.filter("not sieve_met").select("row.*").unionByName(changed)
