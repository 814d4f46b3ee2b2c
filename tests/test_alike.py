"""Kernels that run once for shapes that are the same but for their place."""

import numpy as np
import pyarrow as pa
import pytest

from terraloom.functions import regions as R
from terraloom.operators import alike, polygons
from terraloom.operators.alike import Once, Rows

RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def column(shapes):
    return pa.array([None if s is None else [[{"x": x, "y": y} for x, y in np.asarray(r, float).tolist()] for r in s] for s in shapes], RINGS)


def box(x, y, w, h):
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]


def test_same_shapes_run_once_and_others_each():
    calls = []
    once = Once(lambda s: calls.append(1) or R.area(R.union([s])), "test", object())
    shapes = [box(500.0 * k, 75.0 * k, 40, 25) for k in range(50)] + [box(0, 0, 40, 26), None, [], [[(0, 0), (5, 0)]], [*box(0, 0, 40, 25), *box(10, 5, 10, 10)]]
    got = once(column(shapes))[0]
    assert got == [1000.0] * 50 + [1040.0, 0.0, 0.0, 0.0, 900.0]
    assert len(calls) == 5  # the boxes, the higher box, none, the line, the box with a hole
    assert once(column(shapes))[0] == got and len(calls) == 5


def test_rows_of_slices_and_deep_lists():
    a = column([box(0, 0, 1, 1), None, box(7, 7, 2, 2)])
    rows = Rows(a.slice(1))
    assert [len(rows.row(k, False)) for k in range(2)] == [0, 1] and rows.row(1, False)[0][2].tolist() == [9, 9]
    deep = Rows(pa.array([[box_ for box_ in a.to_pylist() if box_], []], pa.list_(RINGS)))
    assert [len(s) for s in deep.row(0, False)] == [1, 1] and deep.row(1, False) == []


def test_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr(alike, "KEPT", 2000)
    once = Once(lambda s: s[0], "bounded", object())
    for k in range(200):
        got, place, _ = once(column([box(3, 4, 10 + k, 5)]))
        assert (got[0] + place[0])[2].tolist() == [13 + k, 9]
    assert len(alike._KNOWN[once.name]) < 20


@pytest.mark.parametrize("at", [0.0, 3.6e10])
def test_far_shapes_keep_their_size(spark, at):
    """F16: at 36 million kilometres the old kernels' tolerance was 36 m."""
    rows = [(1, box(at, 0, 64, 50)), (2, [[(at, 0), (at + 64, 0), (at, 50)]])]
    df = spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in s]) for k, s in rows], f"fid long, rings {polygons.RINGS}")
    strips = spark.createDataFrame([(1, [[{"x": at + a, "y": -10.0}, {"x": at + b, "y": -10.0}, {"x": at + b, "y": 60.0}, {"x": at + a, "y": 60.0}]]) for a, b in ((8, 32), (24, 48))], f"fid long, rings {polygons.RINGS}")
    got = {r.fid: r.area for r in polygons.coverage(df, strips, 2000.0).collect()}
    want = 50 * 64 / 2 * ((56 / 64) ** 2 - (16 / 64) ** 2)
    assert abs(got[1] - 2000) < 1e-9 and abs(got[2] - want) < 1e-9
    found = {r.fid: r.a for r in df.select("fid", polygons.area(polygons.buffer("rings", 3.0)).alias("a")).collect()}
    assert abs(found[1] - (3200 + 6 * 114 + 9 * 16 * np.sin(np.pi / 16))) < 1e-3


def test_many_edges_match_few(monkeypatch):
    rng = np.random.default_rng(4)
    shapes = [[rng.random((5, 2)) * 30 + rng.random(2) * 300] for _ in range(60)]
    slow = [f(shapes[0], shapes[1:]) for f in (R.difference, R.intersection)] + [R.union(shapes)]
    monkeypatch.setattr(R, "_MANY", 4)
    monkeypatch.setattr(R, "_AT_ONCE", 10)
    monkeypatch.setattr(R, "_PAIRS", 50)
    fast = [f(shapes[0], shapes[1:]) for f in (R.difference, R.intersection)] + [R.union(shapes)]
    for a, b in zip(slow, fast, strict=True):
        assert abs(R.area(a) - R.area(b)) < 1e-9
        assert abs(R.area(R.union([R.outline(b)])) - R.area(b)) < 1e-6


def test_opening_leaves_a_rest(spark):
    from terraloom.operators.channel import opening

    df = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in r] for r in box(900.0, 50.0, 400.0, 200.0)]), (2, [[{"x": x, "y": y} for x, y in r] for r in box(0.0, 0.0, 400.0, 90.0)])], f"fid long, rings {polygons.RINGS}")
    got = {r.fid: r for r in opening(df, 100.0).collect()}
    assert abs(got[1].area + got[1].rest - 80000) < 1e-6 and min(p.x for p in got[1].rings[0]) == 900
    assert got[2].rings == [] and got[2].area == 0 and got[2].rest == 36000


def test_whole_tables_are_walked(spark):
    """no polygon is left out."""
    from terraloom.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    assert QUERIES["centerline"](spark, sf).count() == n and QUERIES["river_analysis"](spark, sf).count() == n
    assert {r.fid % 10 for r in QUERIES["polygon_covers"](spark, sf).collect()} == set(range(8))


def test_points_in_convex_rings():
    ring = np.array([(0, 0), (4, 0), (0, 4)], float)
    inside, outside = np.array([(0, 0), (2, 2), (1, 1)], float), np.array([(1, 1), (2.1, 2)])
    assert polygons._in_convex(inside, ring) and polygons._in_convex(inside, ring[::-1]) and not polygons._in_convex(outside, ring)
    dent = np.array([(0, 0), (4, 0), (1, 1), (0, 4)], float)
    assert not polygons._in_convex(np.array([(0.5, 0.5)]), dent)
    star = np.array([(np.cos(a), np.sin(a)) for a in np.arange(5) * 4 * np.pi / 5])
    assert not polygons._in_convex(np.zeros((1, 2)), star)
