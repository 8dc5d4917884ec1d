"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def groups(rows, n, percent):
    """rows of (id, text) -> {id: (set size, smallest linked id)} by comparing every pair."""
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeats(rows, width):
    """rows of (id, text) -> {id: (bytes, removed, runs, digest of what is left)}."""
    texts = {i: (t or "").encode() for i, t in rows}
    seen = {}
    for i, t in texts.items():
        for s in range(len(t) - width + 1):
            seen[t[s : s + width]] = seen.get(t[s : s + width], 0) + 1
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if seen[t[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        left = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out
