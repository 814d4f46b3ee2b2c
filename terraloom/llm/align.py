"""Word-level edit distance within a band, on bit vectors."""

from __future__ import annotations

import numpy as np


def banded(a: list, b: list, most: int) -> int:
    """The edit distance of a and b, or most + 1 if it is larger.

    Bits of a Python integer hold the vertical differences of the 2 * most + 1
    diagonals around the main one (Myers 1999, banded after Hyyro 2003); the
    window moves down one row with each word of b.
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if not m or not n:
        return max(m, n)
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    d = min(most, max(m, n))
    full = (1 << (2 * d + 1)) - 1
    vp, vn, top, score = ((1 << (d + 1)) - 1) << d, 0, 1 << (2 * d), min(d, m)
    rise = d + 1
    get = at.get
    for j in range(1, n + 1):
        x = get(b[j - 1], 0)
        x = (x << (rise - j) if j < rise else x >> (j - rise)) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j + d <= m:
            score += not d0 & top
        else:
            row = 1 << (m + d - j) if m + d >= j else 0
            score += bool(hp & row) - bool(hn & row)
        if score - (n - max(j, m - d)) > most:  # it falls by one a column at most
            return most + 1
        half = d0 >> 1
        vp = (hn | ~(half | hp)) & full
        vn = half & hp
    return min(score, most + 1)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """1 - distance / longer length, or 0 if that is under least. Equal ends are cut off first; a count of common words rejects early."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    short = min(len(a), len(b))
    if longer - short > most:
        return 0.0
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    if short:
        differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
        tail = int(differ[0]) if len(differ) else short
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return 1 - max(len(a), len(b)) / longer
    u, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    common = np.minimum(np.bincount(inv[: len(a)], minlength=len(u)), np.bincount(inv[len(a) :], minlength=len(u))).sum()
    if max(len(a), len(b)) - common > most:
        return 0.0
    distance = banded(inv[: len(a)].tolist(), inv[len(a) :].tolist(), most)
    return 1 - distance / longer if distance <= most else 0.0
