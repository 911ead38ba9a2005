"""MinHash near-duplicates by an LSH forest, links confirmed on full sets.

A document's set is that of its distinct shingles; documents are linked where
the sets' Jaccard similarity reaches the threshold, and components of linked
documents are the near-duplicate groups.

Forest. A signature of 128 minima is read in 32 orders, each starting at another
place. In each order all signatures are sorted; documents that share an order's
first four minima are a region, and lie next to each other. Two documents of
similarity 0.8 miss each other in the regions of all 32 orders with a probability
of 5e-8.

Candidates are a document's neighbours of the longest common prefix: the one
before it in sorted order, the smallest document of its region, and the smallest
of its leaf. Leaves have a depth of their own: a region of more than
``region_limit`` documents is parted by one more minimum, then by two, and so on up
to eight, until it is within the limit. Sorted rows are dealt by range, so a
region may lie in several tasks: each takes its part, and the parts' ends are
then looked at together.

When those links are confirmed, documents of a leaf within the limit that still
belong to different components are all compared. No step makes pairs of documents
that are known to be connected.

What is still apart in a region over the limit is joined exactly, all such
documents at once: two sets that are similar enough share a shingle among the
rarest of each (prefix filter), so each document is listed under those, and
documents of different components that meet there are candidates. Rarity comes
from a table of ``BUCKETS`` counts; any order that is the same for all documents
is right, a count shared by chance only costs candidates. So depth and limit
decide what a pair costs, never whether it is seen.

Equal sets are one class, represented by its first row, and only representatives
enter the forest, so a text with any number of copies costs no more than one.
Candidates are confirmed by counting the shingles the two full sets share.
Components come from repeated exchange of the smallest row along the links, with
the labels written to a table after each step.

Shingles are ``shingle`` words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in
lower case, compared by 64-bit hashes. A text of fewer words is one shingle.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; repeated rows are copies of each other and each get
their own result row; rows that share an id but not a text are linked each by its
own text, and only the group of a row tells its component; rows with a null id are
linked with nothing, are kept, and have a null component; an empty table gives an
empty result; texts of any length count whole; other columns are ignored (or
passed through by ``drop_near_duplicates``).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import as_bytes, materialize, pick, session_of, sieve, slices, without
from .words import LOWER, hashes, mix, runs

SHINGLE = 5
THRESHOLD = 80
TREES = 32
#: Minima that the documents of a region share, and those that part it, a byte of
#: each.
LEVEL = 4
DEPTHS = 8
REGION_LIMIT = 32
#: Rows of a sorted order that are looked at together.
CHUNK = 100_000
#: Counts that tell rare shingles from common ones, and those in one row.
BUCKETS = 1 << 17
PART = 1 << 13
#: Documents listed under a shingle that one task compares with others.
LISTED = 1024

_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, size=(2, TREES * LEVEL), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    h = hashes(raw.translate(LOWER).split())
    if not len(h):
        return h
    if len(h) < size:
        return runs(h, len(h)) ^ np.uint64(len(h))
    return np.unique(runs(h, size))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions."""
    least = np.full(TREES * LEVEL, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * _SEEDS[0] + _SEEDS[1]
        np.minimum(least, (part >> np.uint64(32)).min(axis=0), out=least)
    return least


def orders(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each order its region's key (the first minima and the order, hashed)
    and what comes next: a byte of each following minimum, the first one highest."""
    four = sig.reshape(TREES, LEVEL)
    key = np.arange(TREES, dtype=np.uint64)
    for n in range(LEVEL):
        key = mix(key ^ four[:, n]) * np.uint64(0x9E3779B97F4A7C15)
    following = sig[(LEVEL * np.arange(1, TREES + 1)[:, None] + np.arange(DEPTHS)) % len(sig)]
    return mix(key), (following & np.uint64(0xFF)).astype(np.uint8).view(">u8")[:, 0].astype(np.uint64)


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, prints, found, offsets = [], [], [], [0]
            for raw in as_bytes(batch.column("text")):
                shingles = shingle_set(raw, size)
                counts.append(len(shingles))
                if len(shingles):
                    prints.append(blake2b(shingles.tobytes(), digest_size=16).digest())
                    found.append(orders(signature(shingles)))
                else:
                    prints.append(None)
                offsets.append(offsets[-1] + TREES * bool(len(shingles)))
            lists = []
            for part in range(2):
                flat = np.concatenate([f[part] for f in found]).view(np.int64) if found else np.empty(0, np.int64)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rid"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), *lists], ["id", "rid", "n", "print", "keys", "rests"]
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingle_set(raw, size) for raw in as_bytes(batch.column("text"))]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "s"])

    return run


def _depths(key: np.ndarray, rest: np.ndarray, size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted rows, with the sizes of their regions: the key of each one's
    leaf, the row at which the leaf begins, and its size."""
    leaf, begin, held = key.copy(), np.zeros(len(key), np.int64), size.copy()
    open_ = np.ones(len(key), bool)
    for depth in range(DEPTHS + 1):
        prefix = rest >> np.uint64(64 - 8 * depth) if depth else np.zeros_like(rest)
        new = np.append(True, (key[1:] != key[:-1]) | (prefix[1:] != prefix[:-1]))
        run = np.cumsum(new) - 1
        count = np.bincount(run)[run]
        begin[open_] = np.flatnonzero(new)[run][open_]
        held[open_] = count[open_]
        if depth:
            leaf[open_] = mix(key[open_] ^ mix(prefix[open_] + np.uint64(depth << 56)))
        open_ &= held > limit
        if not open_.any():
            break
    return leaf, begin, held


def _smallest(order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The row of least ``order`` among those that begin at the same row."""
    by = np.lexsort((order, begin))
    first = np.append(True, np.diff(begin[by]) != 0)
    out = np.empty(len(order), np.int64)
    out[by] = by[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return out


_MET = ["border", "big", "key", "rest", "node", "n", "large", "leaf", "leaf_large", "hub", "hub_n", "near", "near_n", "prev", "prev_n"]


def _met_schema(kind: str) -> str:
    node = f"struct<id:{kind},rid:long>"
    return (
        f"border boolean, big boolean, key long, rest long, node {node}, n long, large boolean, leaf long, leaf_large boolean, "
        f"hub {node}, hub_n long, near {node}, near_n long, prev {node}, prev_n long"
    )


def _forest(limit: int, whole: bool):
    """Of rows sorted by key and rest: those of regions of two and more, with
    their neighbours. Unless regions are ``whole``, the first and the last region
    may go on in another task: for these come border rows, all of them or, of
    more than the limit, the smallest."""

    def met(rows: pa.Table, ends: bool) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        key, rest = (rows.column(c).to_numpy().view(np.uint64) for c in ("key", "rest"))
        new = np.append(True, key[1:] != key[:-1])
        region = np.cumsum(new) - 1
        begin = np.flatnonzero(new)[region]
        size = np.bincount(region)[region]
        stands = rows.column("big").to_numpy(zero_copy_only=False).astype(bool)
        large = (size > limit) | (np.bincount(region, stands)[region] > 0)
        ended = ~ends | ((region > 0) & (region < region[-1]))
        told = np.flatnonzero(np.where(ended, size > 1, size > limit))
        leaf, leaf_begin, leaf_size = _depths(key, rest, size, limit)
        node = rows.column("node").chunk(0) if rows.column("node").num_chunks else rows.column("node").combine_chunks()
        order = np.unique(np.array(node.field("id").to_pylist()), return_inverse=True)[1]
        hub, near = _smallest(order, begin), _smallest(order, leaf_begin)
        before = np.maximum(np.arange(len(key)) - 1, begin)
        border = np.flatnonzero(~ended & ((size <= limit) | (hub == np.arange(len(key)))))
        take = np.concatenate([told, border])
        if not len(take):
            return None
        is_border = np.arange(len(take)) >= len(told)
        n = rows.column("n").combine_chunks() if rows.column("n").num_chunks != 1 else rows.column("n").chunk(0)
        columns = [
            pa.array(is_border), pa.array(large[take]), pa.array(key[take].view(np.int64)), pa.array(rest[take].view(np.int64)), node.take(pa.array(take)), n.take(pa.array(take)),
            pa.array(large[take]), pa.array(leaf[take].view(np.int64)), pa.array(leaf_size[take] > limit),
        ]
        for of in (hub, near, before):
            columns += [node.take(pa.array(of[take])), n.take(pa.array(of[take]))]
        return pa.RecordBatch.from_arrays(columns, _MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK:
                continue
            rows, held = pa.Table.from_batches(held), []
            if whole:  # the last region waits for its end
                key = rows.column("key").to_numpy()
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                held, rows = rows.slice(cut).to_batches(), rows.slice(0, cut)
            out = met(rows, not whole) if rows.num_rows else None
            if out is not None:
                yield out
        if held:
            out = met(pa.Table.from_batches(held), not whole)
            if out is not None:
                yield out

    return run


def _regions(classes: DataFrame, kind: str, limit: int) -> DataFrame:
    """Rows of regions of two and more documents: ``key, large, leaf, leaf_large,
    node, n`` and the neighbours ``hub, near, prev`` with their sizes."""
    rows = classes.select("node", "n", F.explode(F.arrays_zip("keys", "rests")).alias("z"))
    rows = rows.select(F.col("z.keys").alias("key"), F.col("z.rests").alias("rest"), "node", "n", F.lit(False).alias("big"), F.col("node.rid").alias("rid"))
    dealt = rows.repartitionByRange("key", "rest", "rid").drop("rid").sortWithinPartitions("key", "rest", "node")
    first = materialize(dealt.mapInArrow(_forest(limit, False), _met_schema(kind)), "regions")
    ends = first.filter("border").select("key", "rest", "node", "n", "big").repartition("key").sortWithinPartitions("key", "rest", "node")
    second = materialize(ends.mapInArrow(_forest(limit, True), _met_schema(kind)), "borders")
    return first.filter("not border").unionByName(second).drop("border", "big", "rest")


def _pair(x: str, xn: str, y: str, yn: str) -> list[Column]:
    """Columns a, an, b, bn with the smaller document first."""
    swap = F.col(x) > F.col(y)
    return [F.when(swap, F.col(p)).otherwise(F.col(q)).alias(c) for c, p, q in (("a", y, x), ("an", yn, xn), ("b", x, y), ("bn", xn, yn))]


def _alike(edges: DataFrame, threshold: int) -> DataFrame:
    """Candidates that the sets' sizes allow, each once; columns a, an, b, bn."""
    fits = F.least("an", "bn") * 100 >= F.greatest("an", "bn") * threshold
    return edges.filter(fits & (F.col("a") != F.col("b"))).dropDuplicates(["a", "b"])


def _confirm(edges: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The candidates whose full sets are similar enough. Sets go to the pairs'
    second documents first: the first one of many pairs is sent once."""
    held = edges.join(sets.select(F.col("node").alias("b"), F.col("s").alias("bs")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("as_")), "a")
    shared = F.size(F.array_intersect("as_", "bs")).cast("long")
    return held.filter(shared * 100 >= (F.col("an") + F.col("bn") - shared) * threshold).select("a", "b")


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of shingles, in parts: as many rows from any input."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        flat = batch.column("s").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        counts += np.bincount(_bucket(flat), minlength=BUCKETS)
    if counts.any():
        yield _parts(enumerate(counts.reshape(-1, PART)))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all tasks' counts of the same part."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, c in zip(batch.column("part").to_pylist(), batch.column("c").to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(c, np.int64)
    if total:
        yield _parts(total.items())


def _parts(found) -> pa.RecordBatch:
    parts, counts = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], ["part", "c"])


def _prefixes(counts: np.ndarray, threshold: int):
    """A set's rarest shingles: as many as a partner of any allowed size has to
    meet, the first ``shown`` of them where the partner is no smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown, chosen, offsets = [], [], [0]
            for found in batch.column("s"):
                s = found.values.to_numpy(zero_copy_only=False).view(np.uint64)
                n = len(s)
                least = -(-threshold * n // 100)
                shown.append(n - -(-2 * threshold * n // (100 + threshold)) + 1)
                chosen.append(s[np.lexsort((s, counts[_bucket(s)]))[: n - least + 1]])
                offsets.append(offsets[-1] + len(chosen[-1]))
            flat = np.concatenate(chosen).view(np.int64) if chosen else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "n", "comp")), pa.array(shown, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                ["node", "n", "comp", "shown", "prefix"],
            )

    return run


def _mixed(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, node, n) of regions that hold more than one component, with
    ``comp``."""
    named = regions.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = materialize(named, "named")
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return named.join(materialize(mixed, "mixed"), "key")


def _across(apart: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Candidates (a, an, b, bn) among documents (node, n, comp): every pair of
    different components that is similar enough, and few others."""
    kind = dict(apart.dtypes)["node"]
    held = materialize(sets.join(apart, "node").select("node", "n", "comp", "s"), "apart")
    tally = held.mapInArrow(_tally, "part int, c binary").repartition("part").mapInArrow(_add, "part int, c binary").toArrow()
    counts = np.zeros((BUCKETS // PART, PART), dtype=np.int64)
    for part, c in zip(tally.column("part").to_pylist(), tally.column("c").to_pylist(), strict=True):
        counts[part] = np.frombuffer(c, np.int64)
    counts = counts.reshape(-1)
    listed = held.mapInArrow(_prefixes(counts, threshold), f"node {kind}, n long, comp {kind}, shown long, prefix array<long>")
    listed = materialize(listed.select("node", "n", "comp", "shown", F.posexplode("prefix").alias("at", "t")), "listed")

    # most documents under a shingle may be of one component: these don't meet
    by_comp = listed.groupBy("t", "comp").agg(F.count("*").alias("c"), F.sum((F.col("at") < F.col("shown")).cast("long")).alias("shown"))
    tokens = by_comp.groupBy("t").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("shown").alias("shown"))
    tokens = tokens.filter("comps > 1 and shown > 0").select("t", "main", F.ceil(F.col("shown") / LISTED).cast("int").alias("parts"))
    rows = listed.join(tokens, "t").withColumn("of_main", F.col("comp") == F.col("main"))
    left = rows.filter(F.col("at") < F.col("shown")).select(
        "t", "of_main", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.col("node").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("at").alias("aat")
    )
    sides = F.when(F.col("of_main"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))
    right = rows.select("t", "parts", F.explode(sides).alias("of_main"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"), F.col("at").alias("bat"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # what can still be shared from the place on where they meet
    rest = F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat"))
    met = left.join(right, ["t", "of_main", "part"]).filter("ac <> bc and (an < bn or an = bn and a < b)")
    return met.filter(rest * (100 + threshold) >= (F.col("an") + F.col("bn")) * threshold).select(*_pair("a", "an", "b", "bn"))


def link_near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = SHINGLE,
    threshold: int = THRESHOLD,
    region_limit: int = REGION_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: ``id_col, rid, n_shingles, component_id, kept``; ``threshold`` is
    a percentage."""
    session_of(docs)
    kind = dict(docs.dtypes)[id_col]
    texts = _texts(docs, id_col, text_col)
    schema = f"id {kind}, rid long, n long, print binary, keys array<long>, rests array<long>"
    profile = materialize(texts.mapInArrow(_profile(shingle), schema), "signatures")
    node = F.struct("id", "rid")
    classes = profile.filter("id is not null and n > 0").groupBy("print").agg(F.min_by(F.struct(node.alias("node"), "n", "keys", "rests"), node).alias("f"))
    classes = materialize(classes.select("print", "f.*"), "classes")
    regions = _regions(classes, kind, region_limit)
    members = materialize(regions.select("node").dropDuplicates(), "members")
    named = texts.withColumn("node", node)
    held = sieve(named, members.select("node.rid"), "rid").dropDuplicates(["id", "rid"]).join(members, "node", "left_semi")
    sets = materialize(held.mapInArrow(_sets(shingle), f"node struct<id:{kind},rid:long>, s array<long>"), "sets")

    stars = None
    for x in ("hub", "near", "prev"):
        star = regions.select(*_pair(x, f"{x}_n", "node", "n"))
        stars = star if stars is None else stars.unionByName(star)
    links = materialize(_confirm(_alike(stars, threshold), sets, threshold), "links")
    labels = connected_components(links)

    # what is still apart in leaves within the limit
    leaves = _mixed(regions.filter("not leaf_large").select(F.col("leaf").alias("key"), "node", "n"), labels)
    left = leaves.select("key", F.col("node").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"))
    right = leaves.select("key", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"))
    across = left.join(right, "key").filter("a < b and ac <> bc").select("a", "an", "b", "bn")
    more = materialize(_confirm(_alike(across, threshold), sets, threshold), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = connected_components(links)

    # and in regions beyond it
    apart = _mixed(regions.filter("large").select("key", "node", "n"), labels).select("node", "n", "comp").dropDuplicates(["node"])
    apart = materialize(apart, "apart")
    if not apart.isEmpty():
        more = materialize(_confirm(_alike(_across(apart, sets, threshold), threshold), sets, threshold), "links")
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))

    firsts = classes.select("print", "node").join(labels.withColumnRenamed("id", "node"), "node", "left").select("print", F.coalesce("comp", "node").alias("comp"))
    out = profile.select("id", "rid", "n", "print").join(firsts, "print", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce(F.col("comp.id"), F.col("id")))
    out = out.select("id", "rid", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def _rid(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), _rid(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest of their component (and, of repeated
    rows of one id, all); columns stay as they are."""
    found = link_near_duplicates(docs, shingle=shingle, threshold=threshold, id_col=id_col, text_col=text_col)
    gone = materialize(found.filter("not kept").select(F.col(id_col).alias("id"), "rid").dropDuplicates(), "gone")
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), _rid(id_col, text_col).alias("rid"))
    return without(named, gone, "rid", "id").select("row.*")
