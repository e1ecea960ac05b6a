"""Brute force that the tests of this folder share."""

from __future__ import annotations


def removed(rows, split, width):
    """Sorted (id, parts, parts removed, parts kept) of each row: parts covered by a window of ``width`` that also starts
    in a row with a smaller id. No id is larger than any; rows may repeat an id."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        x = split(t or "")
        for k in range(len(x) - width + 1):
            w = tuple(x[k : k + width])
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = []
    for i, t in rows:
        x = split(t or "")
        gone = [False] * len(x)
        for k in range(len(x) - width + 1):
            if first[tuple(x[k : k + width])] < rank(i):
                gone[k : k + width] = [True] * width
        out.append((i, len(x), sum(gone), [y for y, g in zip(x, gone, strict=True) if not g]))
    return sorted(out, key=str)
