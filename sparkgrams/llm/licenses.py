"""License scans: template-markup matching over whole texts.

A template is a licence text in markup: ``<<opt>> .. <</opt>>`` encloses words
that may be left out, ``<<var:A-B>>`` stands for A to B arbitrary words, and all
other words are mandatory and must match exactly, in order. Optional regions may
hold others, and replaceable ones. A template compiles to a token automaton (states
are positions, optional regions are empty moves past them, replaceable regions are
counted steps); a text has the template's label wherever the automaton accepts a
run of its words. The automata start only at places that hold the template's first
run of mandatory words.

Texts are compared as words: A-Z in lower case, then maximal runs of letters a-z,
digits and non-ASCII characters.

Of the accepted runs of one template, the one that starts first is reported, as
long as it can be, and then those that start after its end; runs of different
templates may overlap.

Defined results: a null text is an empty one: no words, no places, empty labels,
score 0; repeated rows, and rows with a null id, are scanned each; an empty table
gives an empty result; texts of any length are scanned whole; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import as_bytes, pick, session_of, slices

#: Phrases that are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_WARRANTY = (
    "this software is provided by <<var:1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed in no event shall <<var:1-12>> be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of "
    "liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution "
)
#: Templates and their labels; the bodies are the licences' own words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license <<opt>>version<</opt>> 2 0"),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "<<opt>>http <<opt>>s<</opt>><</opt>> <<opt>>https<</opt>> <<opt>>www<</opt>> apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
    ),
    ("cc-by-nc-4.0", "<<opt>>licensed under<</opt>> cc by nc <<var:0-1>> 4 0"),
    ("cc-by-4.0", "licensed under <<opt>>a<</opt>> <<opt>>creative commons<</opt>> cc by 4 0"),
    ("cc-by-sa", "<<opt>>licensed under<</opt>> cc by sa <<opt>>4 0<</opt>>"),
    ("gpl-3.0", "<<opt>>this work is<</opt>> licensed under the gnu general public license <<opt>>version<</opt>> 3"),
    ("gpl-2.0", "<<opt>>this work is<</opt>> licensed under the gnu general public license <<opt>>version<</opt>> 2"),
    (
        "gpl-notice",
        "you can redistribute it and or modify it under the terms of the gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license as published by the free software "
        "foundation <<var:0-12>> version <<var:1-1>>",
    ),
    (
        "gpl-notice-full",
        "is free software <<opt>>you can redistribute it and or modify it under the terms of the gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license as published by "
        "the free software foundation either version <<var:1-2>> of the license or at your option any later version<</opt>> <<var:0-10>> distributed in the hope that it will be useful but "
        "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general "
        "public license for more details",
    ),
    ("mit", "<<opt>>released<</opt>> <<opt>>licensed<</opt>> under the mit license"),
    (
        "mit-full",
        "permission is hereby granted free of charge to any person obtaining a copy of this <<var:1-6>> to deal in <<var:1-4>> without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the <<var:1-3>> and to permit persons to whom the <<var:1-3>> is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial "
        "portions of the <<var:1-3>> the <<var:1-3>> is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall <<var:1-8>> be liable for any claim damages or other liability whether in an action of contract tort or "
        "otherwise arising from out of or in connection with the <<var:1-3>> or the use or other dealings in the <<var:1-3>>",
    ),
    (
        "isc-full",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and <<var:1-6>> disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall <<var:1-6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use "
        "data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-full", f"{_BSD} {_WARRANTY}"),
    (
        "bsd-3-full",
        f"{_BSD} <<opt>>3<</opt>> neither the name of <<var:1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
        f"prior written permission {_WARRANTY}",
    ),
    (
        "zlib-full",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions <<opt>>1<</opt>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product "
        "an acknowledgment in the product documentation would be appreciated but is not required <<opt>>2<</opt>> altered source versions must be plainly marked as such and must not be "
        "misrepresented as being the original software <<opt>>3<</opt>> this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense-full",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code "
        "form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    ("copyright", "copyright <<opt>>c<</opt>> <<var:1-6>> all rights reserved"),
    ("reserved-notice", "all rights reserved <<opt>>worldwide<</opt>>"),
)

#: Bytes as a scan sees them: A-Z lower, separators as spaces.
SCAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Automaton:
    """States 0..n; ``moves[s]`` gives (word or None for any, next state), and
    ``free[s]`` the states that s reaches without a word."""

    label: str
    moves: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    anchor: bytes = b""
    before: int = 0

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def longest(self, words: Sequence[bytes], start: int) -> int:
        """Words of the longest accepted run from ``start``, or -1."""
        states, best, last = self.closure({0}), -1, len(self.moves) - 1
        for n in range(start, len(words) + 1):
            if last in states:
                best = n - start
            if n == len(words):
                break
            states = self.closure({t for s in states for w, t in self.moves[s] if w is None or w == words[n]})
            if not states:
                break
        return best


def parse_template(label: str, markup: str) -> list:
    """The parts of a template: words, (least, most) and lists of parts that may
    be left out."""
    tree: list = []
    open_ = [tree]
    for token in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        if token == "<<opt>>":
            open_[-1].append([])
            open_.append(open_[-1][-1])
        elif token == "<</opt>>":
            open_.pop()
            if not open_:
                raise ValueError(f"template {label} ends a region that has not begun")
        elif token.startswith("<<"):
            found = re.fullmatch(r"<<var:(\d+)-(\d+)>>", token)
            if not found or int(found[1]) > int(found[2]):
                raise ValueError(f"template {label} has unknown markup {token}")
            open_[-1].append((int(found[1]), int(found[2])))
        else:
            open_[-1].append(token)
    if len(open_) > 1:
        raise ValueError(f"template {label} does not end a region")
    if not any(isinstance(part, str) for part in tree):
        raise ValueError(f"template {label} has no mandatory words")
    return tree


def most_words(part) -> int:
    """The most words that a part can take."""
    return 1 if isinstance(part, str) else part[1] if isinstance(part, tuple) else sum(map(most_words, part))


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of one template. Its anchor is the first run of mandatory
    words, and ``before`` the most words that can precede that run."""
    auto, tree = Automaton(label), parse_template(label, markup)

    def add(part, at: int) -> int:
        """Compile a part from a state on; the state at its end."""
        if isinstance(part, str):
            end = auto.state()
            auto.moves[at].append((part.encode(), end))
            return end
        if isinstance(part, tuple):
            for n in range(part[1]):
                end = auto.state()
                auto.moves[at].append((None, end))
                if n >= part[0]:
                    auto.free[at].append(end)
                at = end
            return at
        end = at
        for inner in part:
            end = add(inner, end)
        if end != at:
            auto.free[at].append(end)
        return end

    at = 0
    for part in tree:
        at = add(part, at)
    first = next(n for n, part in enumerate(tree) if isinstance(part, str))
    run = list(takewhile(lambda part: isinstance(part, str), tree[first:]))
    auto.anchor, auto.before = " ".join(run).encode(), sum(map(most_words, tree[:first]))
    return auto


def template_pattern(label: str, markup: str) -> str:
    """A regular expression for a template in a text whose words all have one
    space before them: what SQL can be asked."""

    def pattern(part) -> str:
        if isinstance(part, str):
            return f" {part}"
        if isinstance(part, tuple):
            return f"( [^ ]+){{{part[0]},{part[1]}}}"
        return f"({''.join(map(pattern, part))})?"

    return "".join(map(pattern, parse_template(label, markup))) + " "


def starts(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions at which the phrase stands in ``joined``, whose words all
    have one space before and after."""
    out, at, counted, words = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        out.append(words)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


def scan_licenses(
    docs: DataFrame,
    *,
    phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: ``id_col, n_words, n_base, first_word, last_word, base_labels,
    labels, score, n_matched, spans``.

    ``n_base`` counts all places where a phrase's words stand, ``first_word`` and
    ``last_word`` are the smallest and largest start of one. ``labels`` adds
    those of the templates accepted anywhere. ``spans`` lists label, first word
    and length of each accepted run; ``score`` is 1 where a template is accepted,
    0.5 where only phrases stand, and 0 without any.
    """
    session_of(docs)
    schema = (
        f"{id_col} {dict(docs.dtypes)[id_col]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, n_matched long, spans array<struct<label:string,start:long,words:long>>"
    )
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), span]
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_matched", "spans"]
    wanted = [(b" ".join(p.lower().encode().split()), label) for p, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [compile_template(label, markup) for label, markup in templates]
        for batch in slices(batches, text_col):
            rows = []
            for raw in as_bytes(batch.column(text_col)):
                words = raw.translate(SCAN).split()
                joined = b" " + b" ".join(words) + b" "
                base, labels, spans = [], set(), []
                for phrase, label in wanted:
                    found = starts(joined, phrase)
                    base += found
                    labels |= {label} if found else set()
                base_labels = ",".join(sorted(labels))
                for auto in automata:
                    at = -1
                    for anchor in starts(joined, auto.anchor):
                        for start in range(max(at, anchor - auto.before, 0), anchor + 1):
                            length = auto.longest(words, start)
                            if length > anchor - start:
                                spans.append((auto.label, start, length))
                                at = start + length
                                break
                labels |= {s[0] for s in spans}
                rows.append((
                    len(words), len(base), min(base, default=None), max(base, default=None), base_labels, ",".join(sorted(labels)),
                    1.0 if spans else 0.5 if base else 0.0, len(spans), [dict(zip(("label", "start", "words"), s, strict=True)) for s in spans],
                ))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], names)

    return pick(docs, id_col, text_col).mapInArrow(scan, schema)
