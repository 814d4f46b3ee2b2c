"""From a folder of files to a verified package, and the files themselves."""

import json
import struct

import numpy as np
import pytest


def project(folder):
    from terraloom.sinks.files import write_tiff
    from terraloom.sources.vector import write_dbf, write_shp

    box = lambda x, y, s: [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]
    for name, shapes, rows in (
        ("电力设施敏感点/输电线路220kV_保护范围", [("Polygon", box(2000.0, 2000.0, 500.0)), ("Polygon", [(0.0, 0.0), (10.0, 10.0), (0.0, 0.0)])], [{"name": "a"}, {"name": "b"}]),
        ("生态敏感点/国家级自然保护区核心区", [("Polygon", box(4000.0, 4000.0, 800.0))], [{"name": "核心"}]),
        ("交通敏感点/高速公路", [("LineString", [(0.0, 0.0), (0.0, 120.0)])], [{"name": "G1"}]),
        ("杂项/未知", [("Polygon", box(100.0, 100.0, 50.0))], [{"name": "省道"}]),
        ("河流敏感点/通航河流", [("LineString", [(0.0, 500.0), (160.0, 500.0)])], [{"name": "某江"}]),
    ):
        path = folder / f"{name}.shp"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(write_shp(shapes))
        path.with_suffix(".dbf").write_bytes(write_dbf(rows))
    (folder / "broken.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, 50) + struct.pack("<i", 5) + b"\0" * 10)
    (folder / "control").mkdir()
    point = lambda t, x, y: {"type": "Feature", "properties": {"type": t}, "geometry": {"type": "Point", "coordinates": [x, y]}}
    (folder / "control/start_end.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [point("start", 0, 0), point("end", 6000, 6000)]}), encoding="utf-8")
    write_tiff(np.arange(20.0).reshape(4, 5).astype(np.float32), folder / "地形/DEM.tif", 0.0, 6000.0, 10.0, -9999.0, 4547)
    (folder / "project.json").write_text(json.dumps({"project_name": "t", "voltage_kv": 220, "emit_unconsumed_outputs": True, "resolution_m": 500, "solver_params": {"skeleton_budget_nodes": 5}}), encoding="utf-8")


def test_package_from_a_project_folder(spark, tmp_path):
    from terraloom import run as R
    from terraloom.sinks.files import read_gpkg
    from terraloom.sources.vector import read_tiff, tiff_header

    src, out = tmp_path / "项目", tmp_path / "out"
    src.mkdir()
    project(src)
    got = R.run(spark, str(src), str(out), {"flags": {"allow_planar_2d_mode": True}})
    assert got["verified"] == {"ok": True, "version": "ok", "problems": []}
    assert got["layers"]["linear_cross_indexed"] >= 3 and got["layers"]["preferred_corridors"] == 0
    rows, state = R.read_required_layer(out / "m2/preferred_corridors.gpkg")
    assert (rows, state) == ([], "placeholder_only")
    forbidden, state = R.read_required_layer(out / "m2/forbidden_polygons.gpkg")
    assert state == "ok" and {round(r["area_m2"]) for r in forbidden} >= {640000}
    fixes = json.loads((out / "m2/geometry_fixes_log.json").read_text(encoding="utf-8"))
    assert {f["fix_type"] for f in fixes} >= {"discarded"}
    standard = {r["layer"]: r for r in read_gpkg(out / "m1/standardized_features.gpkg")}
    assert standard["输电线路220kV_保护范围"]["variant"] == "protection" and standard["高速公路"]["std_level2"] == "高速公路"
    assert standard["未知"]["mapping_method"] == "fuzzy_auto" and standard["未知"]["std_level2"] == "省道"
    work = json.loads((out / "m3/workspace.json").read_text(encoding="utf-8"))
    assert work["bbox_origin"] == "start_end" and work["bbox"]["xmax"] == 11000
    mask = (out / "m3/forbidden_mask_coarse.tif").read_bytes()
    h = tiff_header(mask)
    assert (h["width"], h["height"], h["epsg"]) == (32, 32, 4547)
    grid = read_tiff(mask)
    assert grid.sum() > 0 and grid[int((11000 - 4400) / 500), int((4400 + 5000) / 500)] == 1
    assert json.loads((out / "m0/read_log.json").read_text(encoding="utf-8"))["unreadable"]
    assert len(json.loads((out / "m3/rule_config.json").read_text(encoding="utf-8"))) == 65
    assert json.loads((out / "m3/solver_params.json").read_text(encoding="utf-8"))["skeleton_budget_nodes"] == 5
    (out / "m3/workspace.json").write_text("{}")
    assert R.verify(out)["problems"] == [{"path": "m3/workspace.json", "problem": "size"}]
    assert "m3 in" in (out / "run.log").read_text(encoding="utf-8")


def test_settings_are_layered(tmp_path):
    from terraloom import settings as S

    assert S.load(tmp_path)["voltage_kv"] == 500 and not S.load(tmp_path)["has_file"]
    (tmp_path / "project.json").write_text(json.dumps({"voltage_kv": 220, "ice_zone": None, "emit_fine": True, "solver_params": {"skeleton_cutoff_min_m": 400}}))
    s = S.load(tmp_path, {"voltage_kv": 110, "flags": {"emit_unconsumed_outputs": True}})
    assert (s["voltage_kv"], s["ice_zone"], s["flags"]["emit_fine"], s["flags"]["emit_unconsumed_outputs"]) == (110, 10, True, True)
    assert s["solver_params"]["skeleton_cutoff_min_m"] == 400 and s["solver_params"]["skeleton_budget_nodes"] == 12000 and S.srs(s) == 4547


@pytest.mark.parametrize("dtype", ["uint8", "float32"])
def test_tiff_round_trip(tmp_path, dtype):
    from terraloom.sinks.files import write_tiff
    from terraloom.sources.vector import read_tiff, tiff_header

    grid = (np.arange(700 * 900) % 251).reshape(700, 900).astype(dtype)
    data = write_tiff(grid, tmp_path / "a.tif", 5.0, 70.0, 2.5, 0.0, 4548).read_bytes()
    assert (read_tiff(data) == grid).all()
    h = tiff_header(data)
    assert (h["xmin"], h["ymax"], h["res_x"], h["nodata"], h["epsg"], h["dtype"], h["bands"]) == (5.0, 70.0, 2.5, 0.0, 4548, dtype, 1)


def test_cells_of_a_raster(spark, tmp_path):
    from terraloom.sinks.files import write_tiff
    from terraloom.sources.vector import cells

    write_tiff(np.array([[1, 2], [-9, 4]], np.float32), tmp_path / "a.tif", 0.0, 0.0, 1.0, -9.0)
    assert sorted((r.r, r.c, r.value) for r in cells(spark, str(tmp_path)).collect() if r.value is not None) == [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 4.0)]


def test_geopackage_columns_and_geometry(spark, tmp_path):
    from terraloom.sinks.files import read_gpkg, write_gpkg

    df = spark.sql("SELECT 'polygon' AS kind, array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 0D, 'y', 3D))) AS parts, 7L AS fid, 'x' AS Name, 'y' AS name2, map('k', 'v') AS attrs, true AS flag")
    assert write_gpkg(df, tmp_path / "a.gpkg", "layer", 4547) == 1
    row = read_gpkg(tmp_path / "a.gpkg")[0]
    assert row["parts"] == [[(0.0, 0.0), (4.0, 0.0), (0.0, 3.0), (0.0, 0.0)]] and row["fid__2"] == 7 and row["flag"] == 1 and json.loads(row["attrs"]) == {"k": "v"}


def test_wind_and_ice_files_are_found(tmp_path):
    from terraloom.run import wind_ice_vector

    assert wind_ice_vector(str(tmp_path)) is None
    (tmp_path / "风区").mkdir()
    (tmp_path / "风区/z.shp").write_bytes(b"")
    assert wind_ice_vector(str(tmp_path)).endswith("z.shp")
    (tmp_path / "wind.gdb").mkdir()
    (tmp_path / "wind.gdb/a.gdbtable").write_bytes(b"")
    assert wind_ice_vector(str(tmp_path)).endswith("wind.gdb")
