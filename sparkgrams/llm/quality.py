"""Quality classifier: how much better a text compresses with a dictionary of
good text than with one of bad text.

Two zstandard dictionaries are built, from labelled good and from labelled bad
texts of a bounded sample. A text is cut into blocks, so that a dictionary helps
a long text as much as a short one, and every block is compressed with each; the
difference of the two total sizes, divided by the text's size, is turned into a
score by a logistic curve fitted on labelled texts that were kept out of the
dictionaries.

Defined results: a null or empty text has the difference 0; repeated rows are
scored each; of rows that repeat a labelled id the first text and the largest
label count; an empty table gives an empty result; without three labels of each
kind every score is the share of good labels (0.5 without any label); rows with
null labels are not learned from; texts of any length are scored whole; other
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .toxicity import calibrate, score_texts, training_rows

#: Labelled texts that a model learns from, at most.
TRAIN_ROWS = 6_000
DICTIONARY_BYTES = 96 << 10
BLOCK_BYTES = 2048
LEVEL = 3


@dataclass
class QualityModel:
    """Two dictionaries, of at most ``DICTIONARY_BYTES`` each, and the curve."""

    good: bytes = b""
    bad: bytes = b""
    scale: float = 1.0
    shift: float = 0.0
    block: int = BLOCK_BYTES
    level: int = LEVEL
    _tools: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": []}

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """By how much smaller each text gets with the dictionary of good text
        than with the other, as a share of its size."""
        if not self._tools:
            made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in (self.good, self.bad)]
            for d in made:
                d.precompute_compress(level=self.level)
            self._tools = [zstandard.ZstdCompressor(dict_data=d) for d in made]
        out = np.zeros(len(texts))
        good, bad = self._tools
        for row, text in enumerate(texts):
            for at in range(0, len(text), self.block):
                part = text[at : at + self.block]
                out[row] += len(bad.compress(part)) - len(good.compress(part))
        return out / np.maximum(1, [len(t) for t in texts])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), 1 / (1 + math.exp(-self.shift)))
        return 1 / (1 + np.exp(-np.clip(self.scale * self.differences(texts) + self.shift, -35, 35)))


def build_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES, block: int = BLOCK_BYTES) -> bytes:
    """A zstandard dictionary trained on the blocks of the texts, or, where these
    are too few to train on, their content."""
    blocks = [t[at : at + block] for t in texts for at in range(0, len(t), block)]
    try:
        return zstandard.train_dictionary(size, blocks, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:] or b" "


def train_quality(texts: list[bytes], labels: list[int], *, decision: float | None = None) -> QualityModel:
    """Learn from texts and 0/1 labels: dictionaries from two thirds, the curve
    from the rest. With ``decision``, scores from there on are the cut of best
    F1 for the texts of the curve."""
    y = np.asarray(labels, dtype=np.float64)
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    if min(y.sum(), len(y) - y.sum()) < 3:
        return QualityModel(shift=math.log(rate / (1 - rate)))
    order = np.random.default_rng(7).permutation(len(y))
    # both kinds in both parts
    order = np.concatenate([order[y[order] == 1], order[y[order] == 0]])
    held, learn = order[::3], np.delete(order, np.s_[::3])
    model = QualityModel(*(build_dictionary([texts[i] for i in learn if y[i] == kind]) for kind in (1, 0)))
    model.scale, model.shift = calibrate(model.differences([texts[i] for i in held]), y[held], decision)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, rows: int = TRAIN_ROWS, decision: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """A model from at most ``rows`` labelled texts, of those whose ids meet
    ``learn``."""
    texts, marks = training_rows(docs, labels, label_col, F.lit(True) if learn is None else learn, rows, id_col, text_col)
    return train_quality(texts, marks, decision=decision)


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score``, 0 to 1, higher for likelier good."""
    return score_texts(docs, model, id_col=id_col, text_col=text_col)
