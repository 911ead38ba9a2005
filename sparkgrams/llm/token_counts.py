"""Token counts by prefix dynamic programming.

For every text a table holds the exact number of tokens of each of its prefixes;
how many tokens a cut text has, and how much of it fits a budget, are then read
from the table without encoding anything.

The program. A tokenizer's merges give each piece of a text exactly one sequence
of tokens, and a sequence is that one if each two neighbours are what the merges
make of their joined bytes. So the last token of a prefix is the one that ends
there, is a token, and stays apart from the last token of the prefix before it;
the prefix has one token more than that. Whether two tokens stay apart follows
from the merges that make their ends. Files with word ends have
two kinds of last tokens: those of a prefix that goes on, and those that also end
the word, which are counted.

A text's pieces are counted one by one and remembered by their text, as steps
from one character to the next; the text's table is their running sum. Places
where a prefix is split otherwise than the whole text have counts of their own:
inside of contractions, of white space before a word (byte-level files) and of
special strings.

Defined results: a null text is an empty one and has 0 tokens; repeated rows are
counted each; an empty table gives an empty result; other columns are ignored.
Texts of any length are counted whole; time and memory follow the longest text.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .runtime import as_bytes, hold, pick, session_of, slices

#: Pieces, and pairs of tokens, that a worker remembers before it starts anew.
PIECES = 250_000
PAIRS = 300_000
#: Beginnings of pieces, of at most so many letters, that it remembers.
BEGINNINGS = 600_000
SHARED = 40

_SPLIT = re.compile(rf"[{bpe.SPACE}]+|[^{bpe.SPACE}]+")
_TAIL = re.compile(rf"[{bpe.SPACE}]+[^{bpe.SPACE}]*\Z")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_GAP = np.zeros(1, np.int16).tobytes()
_by_path: dict[str, Prefixes] = {}


def prefixes(path: str) -> Prefixes:
    """This worker's counter for a tokenizer file."""
    if path not in _by_path:
        _by_path[path] = Prefixes(path)
        hold(_by_path.clear)
    return _by_path[path]


class Prefixes:
    """Counts of the prefixes of pieces and texts, for one tokenizer file."""

    def __init__(self, path: str):
        self.encoder = encoder = bpe.Encoder(path)
        self.merges = bpe.Merges(path, PAIRS)
        self.vocab = self.merges.tokens
        self.longest = max(map(len, self.vocab))
        self.end = encoder.word_end
        self.special = re.compile("|".join(re.escape(t) for t in encoder.specials) or r"(?!)")
        self.words: dict[str, list[int]] = {}
        #: By a piece's first letters: tokens, the last token, where it begins,
        #: tokens if the word ends there, and the same for one letter less.
        self.begun: dict[str, list] = {}
        self.nothing = [0, "", 0, 0, None]
        counter = self

        class Steps(dict):
            """By a text without white space: its counts' steps. What isn't asked
            for again while so many others are is forgotten."""

            older: dict[str, bytes] = {}

            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= PIECES:
                    self.older = dict(self)
                    self.clear()
                found = self.older.get(chunk)
                if found is None:
                    core = chunk.rstrip(bpe.MARKS)
                    if core != chunk and core.isalpha() and (core.isascii() or counter.encoder.normal(core).isalpha()):  # marks after letters are a piece of their own
                        marks = counter._known(chunk[len(core) :])
                        found = self[core] + array("h", map(sub, marks, [0, *marks[:-1]])).tobytes()
                    else:
                        counts = counter.chunk(chunk)
                        found = array("h", map(sub, counts, [0, *counts[:-1]])).tobytes()
                self[chunk] = found
                return found

        self.steps = Steps()

    def _start(self, letters: str, at: int, nodes: list[list], suffix: str, hint: int) -> int:
        """Where the last token of the first ``at`` letters begins. There is just
        one such place; the likeliest are looked at first."""
        vocab, known, goes = self.vocab, self.merges.known, self.merges.apart
        for start in (hint, at - 1):
            token = letters[start:at] + suffix
            if token in vocab:
                if not start:
                    return 0
                apart = known.get((nodes[start][1], token))
                if apart or apart is None and goes(nodes[start][1], token):
                    return start
        for start in range(max(0, at - self.longest), at - 1):
            token = letters[start:at] + suffix
            if token in vocab and start != hint:
                if not start:
                    return 0
                apart = known.get((nodes[start][1], token))
                if apart or apart is None and goes(nodes[start][1], token):
                    return start
        raise ValueError(f"no tokens for {letters[:at]!r}")

    def piece(self, text: str) -> list[int]:
        """The counts of all prefixes of a piece that is not split, by character."""
        ascii_, end = text.isascii(), self.end
        raw = text.encode()
        letters = raw.decode("latin-1").translate(self.encoder.to_letters)
        size, shared = len(raw), self.begun
        # pieces that begin alike share what is known of their beginnings
        node, known = self.nothing, 0
        if size <= SHARED:
            if len(shared) >= BEGINNINGS:
                shared.clear()
            for known in range(size, 0, -1):
                node = shared.get(letters[:known])
                if node is not None:
                    break
            else:
                node, known = self.nothing, 0
        nodes = [node]
        while node[4] is not None:
            node = node[4]
            nodes.append(node)
        nodes.reverse()
        for at in range(max(known, 1), size + 1):
            if at > known:
                node = [0, "", 0, 0, nodes[-1]]
                nodes.append(node)
                if size <= SHARED:
                    shared[letters[:at]] = node
            else:
                node = nodes[at]
            hint = nodes[at - 1][2]
            if end and not node[3] and (ascii_ or at == size or raw[at] & 0xC0 != 0x80):  # a character ends here
                node[3] = nodes[self._start(letters, at, nodes, end, hint)][0] + 1
            if not node[0] and not (end and at == size):
                node[2] = start = self._start(letters, at, nodes, "", hint)
                node[0], node[1] = nodes[start][0] + 1, letters[start:at]
        which = 3 if end else 0
        if ascii_:
            return [node[which] for node in nodes[1:]]
        return [nodes[at][which] for at in range(1, size + 1) if at == size or raw[at] & 0xC0 != 0x80]

    def _known(self, piece: str) -> list[int]:
        counts = self.words.get(piece)
        if counts is None:
            if len(self.words) >= PIECES // 4:
                self.words.clear()
            self.words[piece] = counts = self.piece(piece)
        return counts

    def _split_piece(self, piece: str) -> list[int]:
        """As ``piece``; a contraction's beginnings are pieces of their own."""
        counts = self._known(piece)
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            mark = self._known("'")[-1]
            return [mark, counts[-1]] if len(piece) == 2 else [mark, mark + self._known(piece[1])[-1], counts[-1]]
        return counts

    def chunk(self, chunk: str) -> list[int]:
        """The counts of all prefixes of a text without white space (files with
        word ends)."""
        text, pieces = self.encoder.normal(chunk), self.encoder.pieces
        if text.isalpha() and len(text) == len(chunk) and (text.isascii() or unicodedata.is_normalized("NFC", chunk)):
            return self.piece(text)
        if len(text) != len(chunk) or not unicodedata.is_normalized("NFC", chunk):
            # characters that change together: a prefix is a text of its own
            parts = (pieces.findall(self.encoder.normal(chunk[:n])) for n in range(1, len(chunk) + 1))
            return [sum(self._split_piece(p)[-1] for p in part) for part in parts]
        out, total = [], 0
        for piece in pieces.findall(text):
            out += [total + c for c in self._split_piece(piece)]
            total = out[-1]
        return out

    def _spaced(self, text: str) -> np.ndarray:
        """The steps of a text for byte-level files."""
        counts, at, total, run = np.zeros(len(text), np.int64), 0, 0, 0
        for piece in self.encoder.pieces.findall(text):
            end = at + len(piece)
            counts[at:end] = total + np.array(self._split_piece(piece))
            if piece[0].isspace() and not (at and run):
                # white space ends a prefix as one piece, whatever follows it
                run = re.compile(rf"[{bpe.SPACE}]*").match(text, at).end()
                spaces, before = self._known(text[at:run]), total
                first = at
            total = int(counts[end - 1])
            if run:
                until = min(run, end)
                counts[at:until] = before + np.array(spaces[at - first : until - first])
                run = 0 if end >= run else run
            at = end
        return np.diff(counts, prepend=0)

    def _plain_steps(self, text: str) -> np.ndarray:
        """The steps of a text without special strings."""
        if not text:
            return np.empty(0, np.int64)
        if not self.end:
            return self._spaced(text)
        if not _ODD_SPACE.search(text):
            joined = _GAP.join(map(self.steps.__getitem__, text.split()))
            if len(joined) == 2 * len(text):  # all white space stands alone, inside
                return np.frombuffer(joined, np.int16)
        parts = (_GAP * len(part) if part[0] in bpe.SPACE_SET else self.steps[part] for part in _SPLIT.findall(text))
        return np.frombuffer(b"".join(parts), np.int16)

    def table(self, text: str) -> np.ndarray:
        """The tokens of the first 0, 1, .. characters of a text."""
        parts, at = [np.zeros(1, np.int64)], 0
        for match in self.special.finditer(text):
            plain = text[at : match.start()]
            parts.append(self._plain_steps(plain))
            # until it is complete, a special string is text like any other
            tail = _TAIL.search(plain)
            tail = plain[tail.start() :] if tail else plain
            begun = np.cumsum(self._plain_steps(tail + match[0][:-1]))
            alone = np.cumsum(self._plain_steps(tail))[-1] if tail else 0
            inside = np.append(begun[len(tail) :] - alone, 1)
            parts.append(np.diff(inside, prepend=0))
            at = match.end()
        parts.append(self._plain_steps(text[at:]))
        return np.cumsum(np.concatenate(parts), dtype=np.int64)


class PrefixCounts:
    """Token counts at every prefix of one text."""

    def __init__(self, text: str, path: str):
        self.table = prefixes(path).table(text)

    def at(self, length: int) -> int:
        """Tokens of the text's first ``length`` characters."""
        return int(self.table[max(0, min(length, len(self.table) - 1))])

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.table <= budget)[-1]) if budget >= 0 else 0


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    budgets: tuple[int, ...] = (),
) -> DataFrame:
    """Per row: ``id_col, n_bytes, n_tokens`` and, for each budget B,
    ``fits_B``: the characters of the longest prefix of the text of at most B
    tokens.

    ``tokenizer`` is the path of a tokenizer file on every machine; special
    tokens are not added, and their strings in a text are handled as the
    library does by default.
    """
    session_of(docs)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long" + "".join(f", fits_{b} long" for b in budgets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, remembers=True):
            prefixes(tokenizer)
            texts = as_bytes(batch.column(text_col))
            tokens = np.empty(len(texts), dtype=np.int64)
            fits = [np.empty(len(texts), dtype=np.int64) for _ in budgets]
            for row, raw in enumerate(texts):
                counts = PrefixCounts(raw.decode(), tokenizer)
                tokens[row] = counts.table[-1]
                for out, budget in zip(fits, budgets, strict=True):
                    out[row] = counts.fit(budget)
            columns = [batch.column(id_col), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens), *map(pa.array, fits)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", *(f"fits_{b}" for b in budgets)])

    return pick(docs, id_col, text_col).mapInArrow(count, schema)
