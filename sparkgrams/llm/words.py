"""Words of texts as 64-bit hashes, and hashes of word runs, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes with A-Z lowered.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position on, where there are so many."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    # doubling: a run of 2m words is two runs of m
    out, have = None, 0
    power, part, size, left = MULTIPLIER, h, 1, n
    while left:
        if left & 1:
            if out is None:
                out = part
            else:
                m = min(len(out), len(part) - have)
                out = out[:m] * power + part[have : have + m]
            have += size
        left >>= 1
        if left:
            part = part[: len(part) - size] * power + part[size:]
            power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
            size *= 2
    return mix(out[: len(h) - n + 1])


def window_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each position on."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x
