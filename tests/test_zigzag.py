"""Lines that turn back, against the named method as a loop."""

import numpy as np
import pytest

from terraloom.operators.lines import islands


def split(p, w, interval, jump=2.5, turn=135.0):
    """The method's steps: jitters go, then cuts at long steps and on both sides of turns."""
    seg = np.hypot(*np.diff(p, axis=0).T)
    mid = float(np.median(seg))
    most, keep = max(jump * interval, 3 * mid), np.ones(len(p), bool)

    def angle(a, b):
        n = np.hypot(*a) * np.hypot(*b)
        return np.degrees(np.arccos(np.clip(a @ b / n, -1, 1))) if n > 0 else 0.0

    for i in range(1, len(p) - 1):
        v, a, b = p[i + 1] - p[i - 1], p[i] - p[i - 1], p[i + 1] - p[i]
        if np.hypot(*v) < 1e-9 or angle(a, b) <= turn:
            continue
        off = abs(a[0] * v[1] - a[1] * v[0]) / np.hypot(*v)
        keep[i] = not (off < 0.6 * (w[i] if w[i] > 0 else mid) and max(np.hypot(*a), np.hypot(*b)) <= most)
    at, q = np.flatnonzero(keep), p[keep]
    cut = set(np.flatnonzero(np.hypot(*np.diff(q, axis=0).T) > most).tolist())
    for i in range(1, len(q) - 1):
        if angle(q[i] - q[i - 1], q[i + 1] - q[i]) > turn:
            cut |= {i - 1, i}
    number = np.cumsum([0, *[int(i in cut) for i in range(len(q) - 1)]])
    return {(int(i), int(n)) for i, n in zip(at, number, strict=True) if (number == n).sum() >= 2}


@pytest.mark.parametrize("width", [None, "w"])
def test_islands_follow_the_method(spark, width):
    """jitters stayed, and turns were cut on one side."""
    rng = np.random.default_rng(7)
    lines = {k: np.cumsum(rng.normal(size=(30, 2)) * rng.choice([10, 10, 10, 60], (30, 1)) + [8, 0], axis=0) for k in range(12)}
    lines[12] = np.array([(0, 0), (30, 0), (60, 0), (40, 3), (90, 0), (120, 0)], float)  # a jitter
    lines[13] = np.array([(0, 0), (30, 0), (60, 0), (30, 30), (30, 0), (0, 0)], float)  # turns of exactly 135 degrees are none
    wide = {k: rng.random(len(p)) * 40 - 5 for k, p in lines.items()}
    rows = [(k, i, float(x), float(y), float(w)) for k, p in lines.items() for i, ((x, y), w) in enumerate(zip(p, wide[k], strict=True))]
    got = islands(spark.createDataFrame(rows, "fid long, i int, x double, y double, w double"), 30.0, width=width).collect()
    for k, p in lines.items():
        if k < 13:
            assert {(r.i, r.island) for r in got if r.fid == k} == split(p, wide[k] if width else np.zeros(len(p)), 30.0), k
    assert {r.island for r in got if r.fid == 13} == {0}
