"""Warped multiset-Jaccard similarity of two texts' grams."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import clamp_warp, single
from .grams import count_gram


#: Numbers from which a cube may not fit a long.
LARGE = 2_000_000


def same_grams(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two gram maps."""
    shared = F.transform(F.map_keys(a), lambda g: F.least(count_gram(a, g), count_gram(b, g)))
    return F.aggregate(shared, F.lit(0).cast("long"), lambda acc, n: acc + n)


def all_grams(chars_a: Column, chars_b: Column, same: Column, arity: int) -> Column:
    """Size of the multiset union, from the padded lengths; 0 if either text is
    shorter than a window."""
    union = chars_a.cast("long") + chars_b - (2 * arity - 2) - same
    return F.when(F.least(chars_a, chars_b) < arity, F.lit(0).cast("long")).otherwise(union)


def diff_grams(same: Column, all_: Column) -> Column:
    return all_ - same


def similarity(same: Column, all_: Column, warp: float) -> Column:
    """As a double: exact integers, divided once, for a warp of 1, 2 or 3."""
    w = clamp_warp(warp)
    if math.isnan(w):
        return F.lit(float("nan"))
    same, all_ = same.cast("long"), all_.cast("long")
    rest = all_ - same
    if abs(w - 1) < 1e-10:
        value = same.cast("double") / all_.cast("double")
    elif w == 2:
        value = (all_ * all_ - rest * rest).cast("double") / (all_ * all_).cast("double")
    elif w == 3:
        # cubes of larger numbers don't fit a long
        exact = (all_ * all_ * all_ - rest * rest * rest).cast("double") / (all_ * all_ * all_).cast("double")
        value = F.when(all_ < LARGE, exact).otherwise(F.lit(1.0) - F.pow(rest.cast("double") / all_.cast("double"), F.lit(3.0)))
    else:
        power = F.pow(all_.cast("double"), F.lit(w))
        value = (power - F.pow(rest.cast("double"), F.lit(w))) / power
    return F.when(all_ == 0, F.lit(0.0)).otherwise(value)


def similarity_single(same: Column, all_: Column, warp: float) -> Column:
    """Rounded once to a 32-bit float."""
    return similarity(same, all_, warp).cast("float")


def matches(similarity_: Column, threshold: float) -> Column:
    """Inclusive, compared in 32 bits; a NaN on either side never matches."""
    if math.isnan(threshold):
        return F.lit(False)
    value = similarity_.cast("float")
    return ~F.isnan(value) & (value >= F.lit(single(threshold)).cast("float"))
