"""Key transformers: functions from Column to Column, composed left to right."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Transform = Callable[[Column], Column]

#: Transformers that a saved corpus can name.
NAMED: dict[str, Transform] = {}


@dataclass(frozen=True)
class KeyTransformer:
    """A chain of steps; the first is applied first."""

    steps: tuple[tuple[str, Transform], ...] = ()

    def __call__(self, column: Column) -> Column:
        return reduce(lambda c, step: step[1](c), self.steps, column)

    def link(self, step: Transform | KeyTransformer, name: str | None = None) -> KeyTransformer:
        if isinstance(step, KeyTransformer):
            return KeyTransformer(self.steps + step.steps)
        return KeyTransformer((*self.steps, (name or getattr(step, "__name__", "custom"), step)))

    def lower(self) -> KeyTransformer:
        return self.link(lower, "lower")

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.steps]

    @classmethod
    def from_names(cls, names: list[str]) -> KeyTransformer:
        unknown = [n for n in names if n not in NAMED]
        if unknown:
            raise ValueError(f"transformers {unknown} aren't registered; add them with register()")
        return cls(tuple((n, NAMED[n]) for n in names))


def register(name: str, transform: Transform) -> Transform:
    NAMED[name] = transform
    return transform


def identity(column: Column) -> Column:
    return column


def lower(column: Column) -> Column:
    return F.lower(column)


def strip_scheme(column: Column) -> Column:
    """A url without what stands up to its first ``://``."""
    return F.regexp_replace(column, r"(?s)^.*?://", "")


def from_pandas(fn, name: str = "pandas") -> Transform:
    """A transformer from a function of pandas Series, for what no built-in
    function can express; it leaves the JVM."""
    udf = F.pandas_udf(fn, "string")
    return register(name, lambda column: udf(column))


for _fn in (identity, lower, strip_scheme):
    register(_fn.__name__, _fn)
