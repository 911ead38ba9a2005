"""A similarity threshold as filters before the exact comparison.

The warp is monotone, so a threshold t on the warped similarity is the bound
``j = 1 - (1 - t)^(1/w)`` on shared over all grams. From it follow a bound on the
sizes' ratio, one on the number of shared grams, and how many of a text's
rarest grams must be looked at so that a partner shares one of them. Bounds are
taken with some slack; the exact predicate decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.config import clamp_warp, single

SLACK = 1e-5


def jaccard_bound(threshold: float, warp: float) -> float:
    """Least shared/all of a match; 0 where nothing can be pruned."""
    t, w = single(threshold), clamp_warp(warp)
    if not t > 0 or math.isnan(w):
        return 0.0
    return max(0.0, 1 - (1 - min(t, 1.0)) ** (1 / w) - SLACK)


def sizes_fit(a: Column, b: Column, bound: float) -> Column:
    return F.least(a, b) >= F.lit(bound) * F.greatest(a, b)


def enough_shared(same: Column, a: Column, b: Column, bound: float) -> Column:
    return same >= F.lit(bound / (1 + bound)) * (a + b) - SLACK


def few_apart(apart: Column, a: Column, b: Column, bound: float) -> Column:
    """For a lower bound of the grams that only one of two texts has."""
    return apart <= F.lit(1 - 2 * bound / (1 + bound)) * (a + b) + SLACK


def prefix_length(size: Column, bound: float) -> Column:
    return size - F.ceil(F.lit(bound) * size) + 1
