"""Smith-Waterman alignment of word sequences, a row of the matrix at a time."""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, 1


def _best_end(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(score, end in a, end in b) of the best local alignment; the first such end."""
    step = GAP * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    best = (0, 0, 0)
    for i, x in enumerate(a):
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] - GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + step) - step
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """(score, start in a, end in a, start in b, end in b); the starts come from the reversed sequences."""
    score, i, j = _best_end(a, b)
    if not score:
        return 0, 0, 0, 0, 0
    _, ri, rj = _best_end(a[:i][::-1], b[:j][::-1])
    return score, i - ri, i, j - rj, j
