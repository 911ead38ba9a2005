"""Packing: bounded-space online packing of token sequences into windows.

Each partition keeps a fixed number of open windows. A document's full windows
are cut off and emitted; what remains goes to the open window that it fills
best. When it fits none, the fullest one is filled up with the remainder's
first tokens and emitted, and the rest is placed again. At the end of the
partition the windows still open are merged: their pieces run on into full
windows, and the last part, shorter than a window, becomes windows whose lengths
are powers of two, which need no padding. So nothing is padded, and no partition
waits for another: there is no shuffle at all, and a lost partition is packed
again alike.

Sequence ids are the partition's number times 2^33 plus a count.

Defined results: a null text is an empty one (a document of its end token only);
repeated rows are packed each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .runtime import as_bytes, pick, session_of, slices

#: Windows that a partition keeps open.
OPEN_WINDOWS = 64


class Packer:
    """One partition's windows. A piece is (document's row, start, length)."""

    def __init__(self, size: int, open_windows: int, first_id: int):
        self.size, self.limit, self.next_id = size, open_windows, first_id
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)
        self.out: list[tuple] = []  # (piece, sequence, offset)

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.out.append((piece, self.next_id, offset))
            offset += piece[2]
        self.next_id += 1

    def add(self, doc, tokens: int) -> None:
        start = 0
        while tokens - start >= self.size:
            self.emit([(doc, start, self.size)])
            start += self.size
        while start < tokens:
            rest = tokens - start
            fits = [n for n, (used, _) in enumerate(self.open) if used + rest <= self.size]
            if not fits and len(self.open) < self.limit:
                self.open.append((rest, [(doc, start, rest)]))
                return
            if fits:
                best = max(fits, key=lambda n: self.open[n][0])
                used, pieces = self.open[best]
                pieces.append((doc, start, rest))
                start = tokens
            else:
                best = max(range(len(self.open)), key=lambda n: self.open[n][0])
                used, pieces = self.open[best]
                rest = self.size - used
                pieces.append((doc, start, rest))
                start += rest
            if used + rest == self.size:
                self.emit(pieces)
                self.open.pop(best)
            else:
                self.open[best] = (used + rest, pieces)

    def finish(self) -> None:
        """Merge the open windows, the fullest first."""
        left = sorted(self.open, key=lambda w: -w[0])
        pieces = [piece for _, held in left for piece in held]
        total = sum(piece[2] for piece in pieces)
        self.open = []
        while total:
            want = self.size if total >= self.size else 1 << (total.bit_length() - 1)
            total -= want
            window = []
            while want:
                doc, start, length = pieces[0]
                take = min(length, want)
                window.append((doc, start, take))
                want -= take
                if take == length:
                    pieces.pop(0)
                else:
                    pieces[0] = (doc, start + take, length - take)
            self.emit(window)


class _Doc:
    """What a piece needs of its document."""

    __slots__ = ("ids", "key", "tokens")

    def __init__(self, key, ids: bytes):
        self.key, self.ids, self.tokens = key, ids, len(ids) // 4


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    size: int = 2048,
    end_id: int = 1,
    open_windows: int = OPEN_WINDOWS,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document's ids, then ``end_id``, into windows of ``size``.

    Returns per piece ``id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, with ``with_ids``, the piece's ids as
    little-endian unsigned 32-bit bytes. Documents whose remainders wait in open
    windows are all that a task holds: at most ``open_windows * size`` tokens,
    besides one slice of its input.
    """
    session_of(docs)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    names = [n.split(" ")[0] for n in schema.split(", ")]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(tokenizer)
        packer = Packer(size, open_windows, TaskContext.get().partitionId() << 33)
        kind = None

        def flush() -> pa.RecordBatch:
            rows = []
            for (doc, start, length), sequence, offset in packer.out:
                ids = doc.ids[4 * start : 4 * (start + length)]
                rows.append((doc.key, start, length, crc32(ids), doc.tokens, sequence, offset, *[ids] * with_ids))
            packer.out = []
            kinds = [kind, *[pa.int64()] * 6, *[pa.binary()] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in slices(batches, text_col, remembers=True):
            kind = batch.column(id_col).type
            for key, raw in zip(batch.column(id_col).to_pylist(), as_bytes(batch.column(text_col)), strict=True):
                doc = _Doc(key, encoder.ids(raw.decode()) + end)
                packer.add(doc, doc.tokens)
            if packer.out:
                yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    return pick(docs, id_col, text_col).mapInArrow(run, schema)
