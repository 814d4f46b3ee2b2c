"""Files, kernels and the streaming wrapper."""

import json
import struct

import numpy as np


def test_shapefile_round_trip(spark, tmp_path):
    from terraloom.sources.vector import read_shp, write_shp

    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]
    (tmp_path / "a.shp").write_bytes(write_shp([("Point", [(1.0, 2.0)]), ("LineString", [(0.0, 0.0), (5.0, 5.0)]), ("Polygon", square)]))
    (tmp_path / "bad.shp").write_bytes(b"x" * 113)
    rows = read_shp(spark, str(tmp_path)).collect()
    good = {r.ordinal: r for r in rows if r.error is None}
    assert [good[i].gtype for i in (1, 2, 3)] == ["Point", "LineString", "Polygon"]
    assert list(zip(good[3].xs, good[3].ys, strict=True)) == square and good[3].parts == [0]


def test_geojson(spark, tmp_path):
    from terraloom.sources.vector import read_geojson

    feature = {"type": "Feature", "properties": {"type": "start", "n": 3}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature | {"geometry": None}]}))
    (tmp_path / "e.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    rows = read_geojson(spark, str(tmp_path)).collect()
    assert [(r.ordinal, r.gtype, json.loads(r.coordinates), r.attrs["type"]) for r in rows] == [(0, "Point", [1, 2], "start")]


def _tiff():
    tags = [(256, 3, 1, struct.pack("<HH", 7, 0)), (257, 3, 1, struct.pack("<HH", 5, 0))]
    far = {33550: struct.pack("<3d", 10, 10, 0), 33922: struct.pack("<6d", 0, 0, 0, 100, 900, 0), 42113: b"-9999\0"}
    at, extra = 8 + 2 + 12 * 5 + 4, b""
    for tag, kind, n in ((33550, 12, 3), (33922, 12, 6), (42113, 2, 6)):
        tags.append((tag, kind, n, struct.pack("<I", at + len(extra))))
        extra += far[tag]
    body = struct.pack("<H", 5) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in tags) + b"\0" * 4
    return b"II*\0" + struct.pack("<I", 8) + body + extra


def test_raster_inventory(spark, tmp_path):
    from terraloom.sources.vector import raster_inventory

    (tmp_path / "dem.tif").write_bytes(_tiff())
    (tmp_path / "no.tif").write_bytes(b"junk")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in raster_inventory(spark, str(tmp_path)).collect()}
    d = rows["dem.tif"]
    assert (d.width, d.height, d.res_x, d.xmin, d.ymax, d.nodata) == (7, 5, 10.0, 100.0, 900.0, -9999.0)
    assert rows["no.tif"].error


def sine(amplitude, offset=30.0):
    x = np.linspace(0, 2000, 201)
    y = amplitude * np.sin(2 * np.pi * x / 1000)
    return x, y, np.concatenate([np.column_stack([x, y + offset]), np.column_stack([x[::-1], y[::-1] - offset])])


def test_centerline_follows_a_channel():
    """A channel of 2 km, 60 m wide, 2268 m along its middle: published figures are 122 points, 2247.0 m and a median width of 51.26 m."""
    from terraloom.operators.channel import axis_scan, centerline, effective_length

    x, y, ring = sine(121.3)
    assert abs(np.hypot(np.diff(x), np.diff(y)).sum() - 2268.2) < 4
    pts, w = centerline([ring], 100.0)
    length = np.hypot(*np.diff(pts, axis=0).T).sum()
    assert abs(len(pts) - 122) <= 3 and abs(length - 2247) < 25 and abs(np.median(w) - 51.26) < 1
    assert np.abs(pts[:, 1] - 121.3 * np.sin(2 * np.pi * pts[:, 0] / 1000)).max() < 12
    assert effective_length(pts, [ring]) > 0.99 * length
    straight = np.array([(0, 0), (1000, 0), (1000, 100), (0, 100)], float)
    pts, w = axis_scan([straight], 100.0)
    assert pts[0, 0] < 1 and pts[-1, 0] > 999 and np.allclose(pts[:, 1], 50) and np.allclose(w, 100)  # ends carried on to the bank
    assert len(centerline([np.array([(0, 0), (1, 0), (0, 0)], float)])[0]) == 0


def test_centerline_around_an_island():
    from terraloom.functions.regions import contains
    from terraloom.operators.channel import centerline

    outer, island = np.array([(0, 0), (900, 0), (900, 120), (0, 120)], float), np.array([(400, 40), (500, 40), (500, 80), (400, 80)], float)
    pts, _ = centerline([outer, island], 100.0)
    assert len(pts) > 5 and contains([outer, island], *pts.T).all()



def test_wide_parts_split_a_dumbbell(spark):
    from terraloom.operators.channel import analysis

    points = [(0, 0), (400, 0), (400, 180), (900, 180), (900, 220), (400, 220), (400, 400), (0, 400)]
    rings = [[{"x": float(x), "y": float(y)} for x, y in points]]
    wide, narrow = analysis(spark.createDataFrame([(1, rings)], "fid long, rings array<array<struct<x: double, y: double>>>"), 200.0)
    corners = (4 - 16 * np.sin(np.pi / 16)) * 100**2  # what a disc of 100 m leaves
    assert abs(wide.first().area - (160_000 - corners)) < 600  # and the wedges at the mouth of the link
    legs = narrow.collect()
    assert legs and all(r.width < 200 for r in legs) and max(r.x2 for r in legs) > 700


def test_stream_routes_what_lands(spark, tmp_path):
    from terraloom.plans.fixtures import Context
    from terraloom.streaming.landing import route_stream

    poly = Context(spark, "/root/testdata/sf0.001").poly
    poly.write.parquet(f"{tmp_path}/in")
    q = route_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", poly.select("*").schema.simpleString()[7:-1].replace(":", " "))
    q.awaitTermination()
    assert {r.sink for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"F", "N", "C"}
