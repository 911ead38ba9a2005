"""Padding and n-gram settings: plain values, turned into literals of a plan."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Pad:
    """What stands before or after a text: nothing, as many spaces as a window
    reaches beyond the text (auto), or a literal string as it is."""

    kind: str = "auto"
    literal: str = ""

    @classmethod
    def none(cls) -> Pad:
        return cls("none")

    @classmethod
    def auto(cls) -> Pad:
        return cls("auto")

    @classmethod
    def of(cls, literal: str) -> Pad:
        return cls("literal", literal)

    def render(self, width: int) -> str:
        return {"none": "", "auto": " " * width, "literal": self.literal}[self.kind]


@dataclass(frozen=True)
class GramConfig:
    """Window width (1 at least) and padding of both sides."""

    arity: int = 2
    pad_left: Pad = field(default_factory=Pad.auto)
    pad_right: Pad = field(default_factory=Pad.auto)

    def __post_init__(self):
        object.__setattr__(self, "arity", max(1, int(self.arity)))

    @property
    def left(self) -> str:
        return self.pad_left.render(self.arity - 1)

    @property
    def right(self) -> str:
        return self.pad_right.render(self.arity - 1)

    def to_dict(self) -> dict:
        pads = ((p.kind, p.literal) for p in (self.pad_left, self.pad_right))
        return {"arity": self.arity, "pads": [list(p) for p in pads]}

    @classmethod
    def from_dict(cls, d: dict) -> GramConfig:
        return cls(d["arity"], *(Pad(*p) for p in d["pads"]))


def clamp_warp(warp: float) -> float:
    """The warp as a 32-bit float within 1 to 3; NaN stays NaN."""
    return warp if math.isnan(warp) else float(np.float32(min(max(warp, 1.0), 3.0)))


def single(x: float) -> float:
    """Rounded to a 32-bit float."""
    return float(np.float32(x))
