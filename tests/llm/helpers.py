"""Brute-force versions that the tests hold the operators against."""

from collections import Counter, defaultdict
from hashlib import sha256


def repeats(rows, window):
    first, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), sha256(b" ".join(kept)).hexdigest())
    return out


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_duplicates(rows, size, threshold=80):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for s in sets[i]:
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= threshold * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def best_windows(docs, items, words, threshold=0.8, gram=5):
    """(doc, item) -> similarity of the best item-sized window, at the threshold
    or above."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v or not w:
                continue
            g = min(gram, len(v))
            size = min(len(v), len(w))
            own = Counter(tuple(v[j : j + g]) for j in range(len(v) - g + 1))
            for s in range(len(w) - size + 1):
                x = w[s : s + size]
                met = Counter(tuple(x[j : j + g]) for j in range(size - g + 1))
                if not met & own:
                    continue
                sim = sum((met & own).values()) / sum((met | own).values())
                if sim >= threshold and sim > out.get((d, i), 0):
                    out[d, i] = sim
    return out
