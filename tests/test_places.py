"""Joins by place: as plain loops give them, and without work for points that repeat a place."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import graph, spatial


def points(spark, rows):
    return spark.createDataFrame(rows, "fid long, x double, y double")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    at = rng.integers(0, 40, (60, 2)) * 50.0
    rows = [(k, *at[rng.integers(len(at))].tolist()) for k in range(300)] + [(900, None, 5.0), (901, float("nan"), 5.0), (902, 90000.0, 0.0), (903, 0.0, -90000.0), (3, -500.0, -500.0), (903, -500.0, -400.0)]
    return [r for r in rows if r[1] is not None and r[1] == r[1]], points(spark, rows)


def test_pairs_within(cloud):
    rows, df = cloud
    want = sorted((a[0], b[0], a[1], b[1], float(np.hypot(a[1] - b[1], a[2] - b[2]))) for a, b in itertools.product(rows, rows) if a[0] < b[0] and np.hypot(a[1] - b[1], a[2] - b[2]) <= 120)
    assert sorted((r.a, r.b, r.ax, r.bx, r.d) for r in spatial.within(df, 120.0).collect()) == want


def test_linked_as_components_of_pairs(cloud):
    rows, df = cloud
    for cutoff in (60.0, 400.0):
        want = sorted(tuple(r) for r in graph.components(spatial.within(df, cutoff)).collect())
        assert sorted(tuple(r) for r in spatial.linked(df, cutoff).collect()) == want


def test_nearest_by_loops(spark, cloud):
    rows, df = cloud
    keyed = df.withColumn("k", F.col("fid") % 2)
    others = keyed.select("k", F.col("fid").alias("sid"), "x", "y", (F.col("fid") * 3).alias("v"))
    for same in (True, False):
        got = {r.fid: (r.distance, r.v) for r in spatial.nearest(keyed, others, "k", "v", same=same).collect()}
        want = {}
        for a in rows:
            own = [(float(np.hypot(a[1] - b[1], a[2] - b[2])), b[0], b[0] * 3) for b in rows if b[0] % 2 == a[0] % 2 and not (same and a[0] == b[0])]
            d, _, v = min(own)
            want[a[0]] = min(want.get(a[0], (np.inf, 0)), (d, v))
        assert got == want


def test_no_work_for_points_that_share_a_place(spark):
    """40,000 points at four places have 200 million pairs within a bin."""
    df = spark.range(40000).select(F.col("id").alias("fid"), (F.col("id") % 2 * 10.0).alias("x"), (F.col("id") % 4 * 5.0).alias("y"))
    assert spatial.linked(df, 30.0).groupBy("c").count().collect() == [(0, 40000)]
    own = df.withColumn("k", F.lit(0))
    near = spatial.nearest(own, own.select("k", F.col("fid").alias("sid"), "x", "y", F.lit(0).alias("v")), "k", "v", same=True)
    assert near.agg(F.count("*"), F.max("distance")).first()[:] == (40000, 0.0)


def test_equal_boxes_meet_once(spark):
    rows = [(k, 0.0, 0.0, 10.0 + k % 2, 5.0) for k in range(30)]
    a = spark.createDataFrame(rows, "fid long, xmin double, ymin double, xmax double, ymax double")
    b = a.withColumn("fid", F.col("fid") + 100).withColumns({"xmin": F.col("xmin") + 4, "xmax": F.col("xmax") + 4})
    pairs = spatial.pair_boxes(a, b, 3.0)
    assert pairs.count() == 4
    assert sorted((r.a_fids, r.b_fids) for r in spatial.expanded(pairs, "a_fids", "b_fids", 4).collect()) == sorted((x[0], y[0] + 100) for x in rows for y in rows)


def test_points_by_place(spark):
    df = points(spark, [(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 9.0, 9.0), (4, None, 1.0)])
    assert sorted(r.fid for r in spatial.at_places(df, lambda p: p.filter("x < 5")).collect()) == [1, 2]


def test_no_broadcast_of_boxes(spark):
    """all boxes went through the driver."""
    from terraloom.plans.catalog import QUERIES

    plan = QUERIES["boundary_distance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan


def test_names_are_matched_after_distinct(spark):
    """the filter was moved below distinct(), so that every row was matched."""
    from terraloom.plans.catalog import QUERIES

    plan = QUERIES["fuzzy_tiers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "names-" in plan


def test_paths_are_measured_in_parts(monkeypatch):
    """all stations of a batch were measured at once."""
    import tracemalloc

    import pyarrow as pa

    from terraloom.operators import paths

    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    line = lambda k, n: [{"x": float(k), "y": 0.0}, {"x": k + 50.0 * n, "y": 7.0}]
    a, b = pa.array([line(k, 100) for k in range(2000)] + [None, []], kind), pa.array([line(k + 5, 90) for k in range(2000)] + [None, line(0, 2)], kind)
    measure, peaks, found = paths.stations(50.0), [], []
    for most in (1 << 30, 1 << 12):
        monkeypatch.setattr(paths, "_STATIONS", most)
        tracemalloc.start()
        found.append(measure(a, b))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert found[0].equals(found[1]) and len(found[0]) == 2002
    assert peaks[1] < peaks[0] / 4
