"""Plane regions against random points, closed forms and each other."""

import numpy as np
import pytest

from terraloom.functions import regions as R


def box(x, y, w, h):
    return [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)]


def star(rng, n):
    """A ring that crosses itself, with a hole."""
    p = rng.random((n, 2)) * 100
    return [p, p[:3] * 0.3 + 35]


@pytest.mark.parametrize("seed", range(8))
def test_booleans_match_points(seed):
    rng = np.random.default_rng(seed)
    a, b, c = star(rng, 7), star(rng, 5), box(*rng.random(2) * 60, 30, 25)
    x, y = rng.random(4000) * 100, rng.random(4000) * 100
    ina, inb, inc = (R.contains(s, x, y) for s in (a, b, c))
    for t, want in ((R.union([a, b, c]), ina | inb | inc), (R.difference(a, [b, c]), ina & ~inb & ~inc), (R.intersection(a, [b, c]), ina & (inb | inc))):
        assert abs(R.area(t) / 1e4 - want.mean()) < 0.03
        rings = R.outline(t)
        near = R.boundary_distance(rings, x, y) < 1e-6 if rings else np.zeros(len(x), bool)
        assert (R.contains(rings, x, y) == want)[~near].all()
        assert abs(R.area(R.union([rings])) - R.area(t)) < 1e-6


def test_buffers_and_clusters():
    disc = 16 * np.sin(np.pi / 16)
    assert abs(R.area(R.buffer(box(0, 0, 10, 4), 3)) - (40 + 2 * 3 * 14 + disc * 9)) < 1e-9
    assert abs(R.area(R.buffer(box(0, 0, 10, 4), -1)) - 16) < 1e-9 and len(R.buffer(box(0, 0, 10, 4), -2.5)) == 0
    hole = [*box(0, 0, 20, 20), *box(5, 5, 10, 10)]
    assert abs(R.area(R.buffer(hole, 1)) - (400 + 80 + disc - 64)) < 1e-9
    two = R.clusters([box(0, 0, 20, 20), box(150, 0, 20, 20), box(900, 0, 20, 20)], 50, 20, 0)
    assert len(two) == 2 and len(R.clusters([box(0, 0, 20, 20)], 5, 0, 10_000)) == 0


def test_area_is_kept_within_bands():
    from terraloom.operators.polygons import _within_band

    rng = np.random.default_rng(3)
    t = R.union([star(rng, 9), star(rng, 6)])
    assert abs(sum(R.area(_within_band(t, lo, lo + 7)) for lo in range(0, 105, 7)) - R.area(t)) < 1e-9


def test_crossing_length():
    ring = box(0, 0, 10, 10)
    assert R.clipped_length(ring, np.array([(-5.0, 5.0), (5.0, 5.0), (5.0, 25.0)])) == 10
    assert R.clipped_length(ring, np.array([(20.0, 0.0), (30.0, 0.0)])) == 0


def test_exact_distance_on_a_grid(spark):
    from terraloom.operators.grid import distance_to

    rng = np.random.default_rng(1)
    bad = rng.random((23, 31)) < 0.02
    rows = [(r, c, bool(bad[r, c])) for r in range(23) for c in range(31)]
    got = {(x.r, x.c): x.distance for x in distance_to(spark.createDataFrame(rows, "r int, c int, bad boolean"), "bad").collect()}
    at = np.argwhere(bad)
    for r, c, _ in rows:
        assert abs(got[r, c] - np.hypot(*(at - [r, c]).T).min()) < 1e-9
    none = distance_to(spark.createDataFrame([(0, 0, False)], "r int, c int, bad boolean"), "bad").first()
    assert none.distance is None


def test_paths_match_a_loop():
    import pyarrow as pa

    from terraloom.operators.paths import Paths, segments

    rng = np.random.default_rng(2)
    lines = [np.cumsum(rng.normal(size=(n, 2)) * 40, axis=0) for n in (2, 9, 9, 300)] + [np.zeros((1, 2)), np.zeros((0, 2))]
    column = pa.array([[{"x": x, "y": y} for x, y in p.tolist()] for p in lines] + [None], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    paths = Paths(column)
    for k, p in enumerate(lines[:4]):
        along = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
        d = np.concatenate([rng.random(20) * along[-1], along, [-5, along[-1] + 9]])
        x, y = paths.at(np.full(len(d), k), d)
        assert np.allclose(x, np.interp(d, along, p[:, 0])) and np.allclose(y, np.interp(d, along, p[:, 1]))
    cut = segments(50.0)(column).to_pylist()
    golden = segments(50.0)(pa.array([[{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 70.0}, {"x": 50.0, "y": 70.0}]])).to_pylist()[0]
    assert [(round(s["x2"], 6), round(s["y2"], 6), round(s["azimuth_deg"], 2)) for s in golden] == [(0, 50, 0), (30, 70, 56.31), (50, 70, 90)]
    assert cut[4] == cut[5] == cut[6] == [] and [s["i"] for s in cut[3]] == list(range(len(cut[3])))
