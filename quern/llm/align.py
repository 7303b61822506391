"""Smith-Waterman alignment of word sequences, many pairs at a time.

A match scores 2; a changed, missing or added word costs 1.
"""

from __future__ import annotations

import numpy as np

MATCH = 2
CELLS = 1 << 18


def _best(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each row of ``a`` with the same row of ``b``, and where in ``b`` it ends."""
    n, m = a.shape
    step = np.arange(m, dtype=np.int32)
    h = np.zeros((n, m + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for j in range(b.shape[1]):
        t = np.where(a == b[:, j : j + 1], MATCH, -1).astype(np.int32)
        t += h[:, :-1]
        np.maximum(t, h[:, 1:] - 1, out=t)
        np.maximum(t, 0, out=t)
        t += step
        np.maximum.accumulate(t, axis=1, out=t)
        t -= step
        h[:, 1:] = t
        top = t.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], j + 1
    return best, end


def local_scores(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (item, text): the best score, and the part of the text aligned with it (start, end)."""
    n = len(pairs)
    score, start, end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = sorted((i for i in range(n) if len(pairs[i][0]) and len(pairs[i][1])), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    lo = 0
    while lo < len(order):
        hi, m = lo + 1, len(pairs[order[lo]][0])
        while hi < len(order) and (hi + 1 - lo) * len(pairs[order[hi]][0]) <= CELLS and len(pairs[order[hi]][0]) <= 1.3 * m + 4:
            hi += 1
        group = order[lo:hi]
        m, w = max(len(pairs[i][0]) for i in group), max(len(pairs[i][1]) for i in group)
        a, b = np.zeros((len(group), m), np.uint64), np.ones((len(group), w), np.uint64)  # padding matches nothing
        for r, i in enumerate(group):
            a[r, : len(pairs[i][0])], b[r, : len(pairs[i][1])] = pairs[i]
        score[group], end[group] = _best(a, b)
        back_a, back_b = np.zeros_like(a), np.ones_like(b)
        for r, i in enumerate(group):
            x, y = pairs[i][0][::-1], pairs[i][1][: end[i]][::-1]
            back_a[r, : len(x)], back_b[r, : len(y)] = x, y
        start[group] = end[group] - _best(back_a, back_b)[1]
        lo = hi
    return score, start, end
