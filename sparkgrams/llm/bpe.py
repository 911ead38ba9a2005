"""Memoised encoding with a public BPE tokenizer file of the ``tokenizers``
library, chunk by chunk.

Both supported kinds of file split a text before they merge bytes, and never
merge over a chunk's border: text between spaces for the word-end kind, a space
with the text after it for the byte-level kind. The ids of a text are then the
ids of its chunks, which mostly repeat, so each worker keeps the ids of chunks
it has met. Texts whose white space or special strings make that split differ
from the library's go to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import regex

from .runtime import hold

#: Chunks a worker remembers before it starts anew; some 150 bytes each.
CACHE_CHUNKS = 200_000
#: ASCII characters that are neither letters, digits nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space of the tokenizers' own regular expressions (Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
SPACE_SET = frozenset([chr(n) for n in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]])
#: How the two kinds of file split a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_by_path: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _by_path:
        _by_path[path] = Encoder(path)
        hold(_by_path.clear)
    return _by_path[path]


def vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """A file's tokens with their ids, and its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]


class Merges:
    """What a file's merges make of two tokens side by side.

    ``tokens`` are those that the merges make of their own letters. A token grows
    from a letter, and what stands at its end changes with each merge that takes
    part in it; these ends and the merges' ranks tell which merge comes first where
    two tokens meet.
    """

    def __init__(self, path: str, pairs: int):
        vocab, merges = vocabulary(path)
        self.rank = {pair: n for n, pair in enumerate(merges)}
        self.pairs, self.known = pairs, {}
        made = {a + b for a, b in merges}
        #: By token: what stands at its right (left) end, from a letter on, and the
        #: ranks of the merges that change it.
        self.right = {t: ((t,), ()) for t in vocab if t not in made}
        self.left = dict(self.right)
        self.tokens = set(self.right)
        for n, (a, b) in enumerate(merges):
            token = a + b
            if token in self.tokens or a not in self.tokens or b not in self.tokens or self._first(a, b) != (True, n):
                continue
            self.tokens.add(token)
            for ends, part in ((self.right, b), (self.left, a)):
                seen, ranks = ends[part]
                ends[token] = ((*seen, token), (*ranks, n))

    def _first(self, a: str, b: str) -> tuple[bool, int] | None:
        """The first merge over the border of two tokens: whether both are whole
        by then, and its rank; None if there is none."""
        (ends, ending), (begins, beginning) = self.right[a], self.left[b]
        rank, x, y, last_x, last_y = self.rank, 0, 0, len(ending), len(beginning)
        while True:
            cross = rank.get((ends[x], begins[y]))
            grow_a = ending[x] if x < last_x else NEVER
            grow_b = beginning[y] if y < last_y else NEVER
            # of merges of one rank the left one comes first
            if cross is not None and cross < grow_a and cross <= grow_b:
                return x == last_x and y == last_y, cross
            if grow_a == grow_b == NEVER:
                return None
            if grow_a <= grow_b:
                x += 1
            else:
                y += 1

    def apart(self, a: str, b: str) -> bool:
        """Whether the merges leave the two tokens as they are."""
        known = self.known.get((a, b))
        if known is None:
            if len(self.known) >= self.pairs:
                self.known.clear()
            known = self.known[a, b] = self._first(a, b) is None
        return known


NEVER = 1 << 62


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level files:
    printable Latin-1 bytes stand for themselves, the others for the code
    points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(other)}


class Encoder:
    """``ids(text)`` gives the ids as little-endian unsigned 32-bit bytes, equal
    to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.word_end = spec["model"].get("end_of_word_suffix") or ""
        self.pieces = regex.compile(WORD_END if self.word_end else BYTE_LEVEL)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)", re.I)
        self.to_letters = byte_alphabet()
        self.merger = None if self.word_end else self._merger(spec["model"])
        self.units = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
        self.words = re.compile(rf"[^{SPACE}]+")
        self.piece_memo: dict[str, bytes] = {}
        memo = self

        class Memo(dict):
            lead = ""

            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= CACHE_CHUNKS:
                    self.clear()
                core = chunk.rstrip(MARKS)
                # marks after letters are a piece of their own
                if core != chunk and core.isalpha():
                    found = self[core] + memo._known(chunk[len(core) :])
                else:
                    found = memo._chunk(self.lead + chunk if chunk[:1] != "\n" else chunk)
                self[chunk] = found
                return found

        class Spaced(Memo):
            """By the text after one space; texts are cut at spaces, and before
            a line end no space is left out."""

            lead = " "

        self.memo, self.spaced = Memo(), Spaced()

    def _merger(self, model: dict):
        """A faster merger of one piece's bytes, where ids follow the order of
        the merges, as it needs."""
        import tiktoken

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + n for n, (a, b) in enumerate(pairs)):
            return None
        to_byte = {c: b for b, c in self.to_letters.items()}
        made = [a + b for a, b in pairs]
        ranks = {bytes(to_byte[c] for c in token): model["vocab"][token] for token in [*self.to_letters.values(), *made]}
        return tiktoken.Encoding("pieces", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _piece(self, piece: str) -> bytes:
        if self.merger is not None:
            return array("I", self.merger.encode_single_piece(piece.encode())).tobytes()
        letters = piece.encode().decode("latin-1").translate(self.to_letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _known(self, piece: str) -> bytes:
        ids = self.piece_memo.get(piece)
        if ids is None:
            if len(self.piece_memo) >= CACHE_CHUNKS // 4:
                self.piece_memo.clear()
            self.piece_memo[piece] = ids = self._piece(piece)
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if chunk.removeprefix(" ").isalpha():
            return self._piece(chunk)
        return b"".join(map(self._known, self.pieces.findall(chunk)))

    def normal(self, text: str) -> str:
        """The text as the word-end kind's pieces see it, but for white space."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the library has no final sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def chunks(self, text: str) -> list[bytes]:
        """Ids of each chunk, in order."""
        if self.special.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return [array("I", ids).tobytes()]
        if self.word_end:
            text = self.normal(text)
            words = text.split() if not _ODD_SPACE.search(text) else self.words.findall(text)
            return list(map(self.memo.__getitem__, words))
        if not text:
            return []
        if " ".join(text.split()) == text.replace("\n", " "):
            first, *rest = text.replace("\n", " \n").split(" ")
            return [self.memo[first], *map(self.spaced.__getitem__, rest)]
        return list(map(self.memo.__getitem__, self.units.findall(text)))

    def ids(self, text: str) -> bytes:
        return b"".join(self.chunks(text))


_ODD_SPACE = re.compile("[\x1c-\x1f]")
