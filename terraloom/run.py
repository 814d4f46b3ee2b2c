"""From a project folder to a delivery package: read, classify, route, compile, write, verify.

    python -m terraloom.run --project_dir data --output_dir out

Every layer is a DataFrame until it is written: Parquet tables hold the rows,
GeoPackage, GeoTIFF and JSON files beside them are what other programs read.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
import time
from datetime import datetime
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom import settings as S
from terraloom.functions import cost
from terraloom.operators import classify, gates, ingest, lines, polygons, route
from terraloom.operators import grid as G
from terraloom.plans.catalog import QUERIES
from terraloom.plans.fixtures import VIEWS
from terraloom.rules import rules as rule_table
from terraloom.sinks import files
from terraloom.sources import vector

VERSION = "1.0"
CONTROLS = ("start_end", "must_pass", "must_path", "dense_corridor", "accessible_area")
SINKS = {"F": "forbidden_polygons", "N": "no_tower_polygons", "C": "cost_polygons"}
MD5_BELOW = 500 << 20
log = logging.getLogger("terraloom")


def logging_to(folder: Path, level: int = logging.INFO) -> None:
    """Console and a file in the folder; handlers of an earlier run go."""
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    log.setLevel(level)
    for h in (logging.StreamHandler(), logging.FileHandler(files.ensure_dir(folder) / "run.log", encoding="utf-8")):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)


# --- M0: read -----------------------------------------------------------------------------------------------

_PARTS = "array<array<struct<x: double, y: double>>>"


def features(spark: SparkSession, project_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fid, kind, parts, attrs, layer, folder, dataset) of all shapefiles and GeoJSON files outside control/, and what couldn't be read (source_path, error)."""
    shp = vector.scan_shp(spark, project_dir)
    cut = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.slice(F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")), F.get("parts", i) + 1, F.coalesce(F.get("parts", i + 1), F.size("xs")) - F.get("parts", i)))
    a = shp.filter("error IS NULL").select("source_path", "ordinal", "gtype", cut.cast(_PARTS).alias("parts"), "attrs")
    geo = vector.read_geojson(spark, project_dir).filter("source_path NOT LIKE '%/control/%'")
    pair = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    line, rings = F.from_json("coordinates", "array<array<double>>"), F.from_json("coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    as_points = lambda r: F.transform(r, pair)
    parts = (
        F.when(F.col("gtype") == "Point", F.array(F.array(pair(F.from_json("coordinates", "array<double>")))))
        .when(F.col("gtype").isin("LineString", "MultiPoint"), F.array(as_points(line)))
        .when(F.col("gtype").isin("Polygon", "MultiLineString"), F.transform(rings, as_points))
        .when(F.col("gtype") == "MultiPolygon", F.transform(many, as_points))
    )
    b = geo.select("source_path", "ordinal", "gtype", parts.cast(_PARTS).alias("parts"), "attrs")
    both = a.unionByName(b).filter("parts IS NOT NULL AND size(parts) > 0")
    kind = F.when(F.col("gtype").like("%Point"), "point").when(F.col("gtype").like("%LineString"), "line").when(F.col("gtype").like("%Polygon"), "polygon")
    layer = F.regexp_extract("source_path", r"([^/]+)\.[A-Za-z]+$", 1)
    folder = F.regexp_replace(F.regexp_replace("source_path", r"/[^/]+$", ""), "^.*" + _quoted(str(Path(project_dir).resolve())) + "/?", "")
    named = both.select(F.xxhash64("source_path", "ordinal").alias("fid"), kind.alias("kind"), "parts", "attrs", F.url_decode(layer).alias("layer"), F.url_decode(folder).alias("folder"), F.lit(None).cast("string").alias("dataset"))
    return named, shp.filter("error IS NOT NULL").select("source_path", "error")


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def controls(spark: SparkSession, project_dir: str, settings: dict) -> dict[str, list[dict]]:
    """Control objects by kind: GeoJSON, else shapefile, else, for start and end, the settings; absence is no error."""
    out: dict[str, list[dict]] = {}
    for kind in CONTROLS:
        folder = Path(project_dir) / "control"
        if (folder / f"{kind}.geojson").exists():
            data = json.loads((folder / f"{kind}.geojson").read_text(encoding="utf-8"))
            out[kind] = [{"gtype": f["geometry"]["type"], "coordinates": f["geometry"]["coordinates"], **(f.get("properties") or {})} for f in data.get("features", []) if f.get("geometry") and f["geometry"].get("coordinates")]
        elif (folder / f"{kind}.shp").exists():
            out[kind] = [{"gtype": k, "coordinates": [list(p) for p in zip(xs, ys, strict=True)] if k != "Point" else [xs[0], ys[0]]} for _, k, xs, ys, _ in vector.parse_shp((folder / f"{kind}.shp").read_bytes())]
    if not out.get("start_end"):
        ends = [{"gtype": "Point", "coordinates": list(settings[f"{k}_point"]), "type": k} for k in ("start", "end") if settings.get(f"{k}_point")]
        if ends:
            out["start_end"] = ends
    return out


def placed(control: dict[str, list[dict]], kind: str) -> list[tuple[float, float]]:
    flat: list[tuple[float, float]] = []

    def walk(c):
        if c and isinstance(c[0], (int, float)):
            flat.append((float(c[0]), float(c[1])))
        else:
            for x in c:
                walk(x)

    for f in control.get(kind, []):
        walk(f["coordinates"])
    return flat


def wind_ice_vector(project_dir: str) -> str | None:
    """The first folder with .gdbtable files whose path names wind or ice, else such a shapefile."""
    hit = lambda p: any(w in str(p).lower() for w in ("wind", "ice_zone", "风区", "冰区", "风冰", "覆冰"))
    root = Path(project_dir)
    tables = sorted({p.parent for p in root.rglob("*.gdbtable") if hit(p.parent.relative_to(root))})
    shapes = sorted(p for p in root.rglob("*.shp") if hit(p.relative_to(root)))
    return str(tables[0]) if tables else str(shapes[0]) if shapes else None


# --- M1: classify -------------------------------------------------------------------------------------------


def standardise(found: DataFrame) -> DataFrame:
    """Names from layers, folders and attributes, then class and rule."""
    parsed = ingest.parse_layers(found)
    named = parsed.withColumns({
        "path_level1": F.col("level1"), "path_level2": F.when(F.col("resolution_path") == "rule_table_lookup", F.col("base_level2")), "path_canonical": F.when(F.col("resolution_path") == "rule_table_lookup", F.col("canonical_level2")),
        "theme": F.element_at(F.split("folder", "/"), -1), "raw_level1": classify.discover(F.col("attrs"), classify.LEVEL1_FIELDS), "raw_level2": classify.discover(F.col("attrs"), classify.LEVEL2_FIELDS),
    })
    return classify.classify(named)


# --- M2: geometry -------------------------------------------------------------------------------------------


def geometry_layers(standard: DataFrame, rules: DataFrame, settings: dict) -> dict[str, DataFrame]:
    """The package's layers, each with kind and parts."""
    flags = settings["flags"]
    ruled = route.with_rule(standard, rules).drop("level1", "level2")
    ruled = ruled.select("fid", "kind", "parts", "variant", "layer", F.col("std_level2").alias("given"), "rule.*").withColumn("level2", route.safe_level2(F.col("given"), F.col("level2"))).drop("given")
    shapes = ruled.filter("kind = 'polygon'").withColumn("variant", route.normal_variant(F.col("variant")))
    fixed = shapes.withColumn("_g", F.when(F.col("variant") == "primary", F.struct(F.col("parts").alias("rings"), F.lit(None).cast("string").alias("fix_type"), F.lit(False).alias("discarded"))).otherwise(polygons.repair(F.col("parts"))))
    fixes = fixed.filter("_g.fix_type IS NOT NULL").select("fid", "rule_id", "level2", "variant", F.col("_g.fix_type").alias("fix_type"), F.col("_g.discarded").alias("discarded"))
    whole = fixed.filter("NOT _g.discarded").withColumn("parts", F.col("_g.rings")).drop("_g")
    routed = _routed(whole)
    out = {name: routed.filter(F.col("sink") == s).drop("sink") for s, name in SINKS.items()}
    rows = ruled.filter("kind = 'line'")
    flat = rows.select("fid", "rule_id", "level2", F.posexplode("parts").alias("part", "coords"))
    cut = lines.linear_cross(flat.drop("level2"), rules)
    out["linear_cross_indexed"] = cut.select("segment_id", "parent_feature_id", "rule_id", "level2", F.col("min_angle").alias("min_cross_angle_deg"), F.col("base_cost").alias("cross_cost"), "azimuth_deg", F.lit("line").alias("kind"), F.array(polygons.ring(("x1", "y1"), ("x2", "y2"))).alias("parts"))
    rewarded = whole.filter("variant = 'reward' AND reward > 0").withColumn("parallel_range_m", cost.parallel_range()).withColumn("voltage_kv", cost.voltage_kv(F.col("level2")))
    eco = whole.filter("level1 = '生态敏感点' AND variant <> 'reward'").select("fid", F.col("parts").alias("rings"))
    share = polygons.coverage(rewarded.select("fid", F.col("parts").alias("rings")), eco, 2000.0)
    corridors = rewarded.join(share, "fid", "left").select("fid", "rule_id", "level2", F.col("reward").alias("parallel_reward"), "parallel_range_m", "voltage_kv", F.coalesce("ratio", F.lit(0.0)).alias("eco_overlap_ratio"), F.coalesce("area", F.lit(0.0)).alias("eco_overlap_area"), "kind", "parts")
    if flags["enable_corridor_legacy"]:
        wide = flat.drop("level2").join(F.broadcast(rules.filter("reward > 0")), "rule_id").withColumn("parallel_range_m", cost.parallel_range()).withColumn("voltage_kv", cost.voltage_kv(F.col("level2")))
        legacy = wide.withColumn("parts", polygons.buffer_by(F.array("coords"), F.col("parallel_range_m").cast("double"), lines=True))
        corridors = corridors.unionByName(legacy.select("fid", "rule_id", "level2", F.col("reward").alias("parallel_reward"), "parallel_range_m", "voltage_kv", F.lit(0.0).alias("eco_overlap_ratio"), F.lit(0.0).alias("eco_overlap_area"), F.lit("polygon").alias("kind"), "parts"))
    out["preferred_corridors"] = corridors
    if flags["enable_airport_legacy_processing"]:
        airport = whole.filter("level2 = '机场' AND buffer_m > 0")
        out["forbidden_polygons"] = out["forbidden_polygons"].unionByName(airport.withColumn("parts", polygons.buffer_by(F.col("parts"), F.col("buffer_m").cast("double"))).select(out["forbidden_polygons"].columns))
    if flags["enable_building_cluster_legacy"]:
        p = settings["building_cluster"]
        built = whole.filter("level2 = '建筑物'").select("fid", F.col("parts").alias("rings"))
        found = polygons.clusters(built, float(p["buffer_m"]), float(p["merge_gap_m"]), float(p["min_cluster_area_m2"]))
        out["building_clusters"] = found.select(F.round("area", 1).alias("cluster_m2"), F.lit(p["dense_zone_penalty"]).alias("penalty"), F.lit("polygon").alias("kind"), F.col("rings").alias("parts"))
    out["river_crossing_windows"] = lines.segment(flat.filter("rule_id IN (61, 62)"), "fid", "coords").select("fid", "part", "i", "rule_id", F.lit("river_degraded").alias("emitter"), F.lit("line").alias("kind"), F.array(polygons.ring(("x1", "y1"), ("x2", "y2"))).alias("parts"))
    out["processed_polygons"] = whole.select("fid", "rule_id", "level1", "level2", "variant", "kind", "parts")
    return out | {"geometry_fixes": fixes}


def _routed(whole: DataFrame) -> DataFrame:
    land, base = cost.land_cost(), cost.base_cross_cost()
    source = F.when(F.col("variant") == "protection", "client_protection_range").otherwise("primary")
    sunk = whole.withColumn("sink", F.explode(route.sinks(F.col("variant"))))
    return sunk.select("fid", "rule_id", "level2", "variant", source.alias("source"), land.cast("double").alias("land_cost"), base.cast("double").alias("cross_cost"), "buffer_m", "sink", "kind", "parts")


# --- Writing ------------------------------------------------------------------------------------------------


def write_layer(df: DataFrame, folder: Path, name: str, srs: int, areas: bool = False) -> int:
    """A Parquet table and a GeoPackage; polygons get area_m2, an empty layer a placeholder row. Gives the number of real rows."""
    if areas:
        df = df.withColumn("area_m2", F.round(polygons.area(F.col("parts")), 1))
    spark, path = df.sparkSession, f"{folder}/{name}.parquet"
    df = df.withColumn("_placeholder", F.lit(False))
    df.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    n = stored.count()
    if not n:
        blank = spark.range(1).select(*[F.lit(True).alias(f.name) if f.name == "_placeholder" else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        blank.write.mode("overwrite").parquet(path)
        stored = spark.read.schema(df.schema).parquet(path)
    files.write_gpkg(stored, folder / f"{name}.gpkg", name, srs)
    return n


def read_required_layer(path: str | Path) -> tuple[list[dict], str]:
    """Rows of a GeoPackage without placeholders, and ok, empty, or placeholder_only."""
    every = files.read_gpkg(path)
    real = [r for r in every if not r.get("_placeholder")]
    return real, "ok" if real else "placeholder_only" if every else "empty"


def wind_ice_combination(spark: SparkSession, settings: dict) -> dict:
    """The multiplier and the adder of the project's wind and ice zone; neutral ones where the table has none."""
    rows = spark.sql(VIEWS["zones"]).filter((F.col("wind_zone") == F.lit(settings["wind_zone"])) & (F.col("ice_zone") == F.lit(settings["ice_zone"]))).collect()
    return {"tower_mult": float(rows[0].tower_mult), "adder": float(rows[0].adder)} if rows else {"tower_mult": 1.0, "adder": 0.0}


def raster_fields(spark: SparkSession, layers: dict[str, DataFrame], box: dict, res: float, zone: dict, out: Path, suffix: str, srs: int) -> dict:
    """The masks and cost fields of the workspace as GeoTIFF, polygons burnt by cell centre."""
    rows, cols, dx, dy = G.shape(box["xmin"], box["ymin"], box["xmax"], box["ymax"], res)
    cells = G.centres(G.cells(spark, rows, cols), box["xmin"], box["ymax"], dx, dy).withColumn("fid", F.col("r").cast("long") * cols + F.col("c"))

    def burnt(df: DataFrame, value=None) -> DataFrame:
        hit = polygons.points_inside(cells, df.select("fid", F.col("parts").alias("rings")), 20 * res)
        return hit.select("fid").distinct() if value is None else hit.join(df.select(F.col("fid").alias("pid"), value.alias("v")), "pid").groupBy("fid").agg(F.max("v").alias("v"))

    price = F.greatest(F.col("land_cost"), F.when(F.col("cross_cost") < 999999, F.col("cross_cost")).otherwise(0.0))
    costs = layers["cost_polygons"]
    g = cells
    for name, layer in (("forbidden", burnt(layers["forbidden_polygons"])), ("no_tower", burnt(layers["no_tower_polygons"])), ("excluded", burnt(layers["preferred_corridors"].filter("voltage_kv >= 800")))):
        g = g.join(layer.withColumn(name, F.lit(True)), "fid", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    for name, layer in (("guide", burnt(costs, cost.guide_value(price))), ("tower_guide", burnt(costs.filter("land_cost > 0"), cost.tower_guide(F.col("land_cost")))), ("reward", burnt(layers["preferred_corridors"], F.col("parallel_reward").cast("double")))):
        g = g.join(layer.withColumnRenamed("v", name), "fid", "left")
    g = g.withColumns({"no_tower": F.col("no_tower") | F.col("forbidden"), "peak": F.lit(False), "tower_mult": F.lit(zone["tower_mult"]), "adder": F.lit(zone["adder"])})
    g = G.tower_costs(G.passage_costs(g))
    got = g.select("fid", F.col("forbidden").cast("int").alias("forbidden_mask"), (~F.col("no_tower")).cast("int").alias("tower_mask"), "lpcf", "tscf").toArrow()
    order = np.argsort(got["fid"].to_numpy())
    for name in ("forbidden_mask", "tower_mask", "lpcf", "tscf"):
        v = got[name].to_numpy()[order].reshape(rows, cols)
        files.write_tiff(v.astype(np.uint8 if name.endswith("mask") else np.float32), out / f"{name}_{suffix}.tif", box["xmin"], box["ymax"], dx, None, srs)
    return {"rows": rows, "cols": cols, "res_m": res}


def file_entry(root: Path, name: str) -> dict:
    path = root / name
    if not path.exists():
        return {"path": name, "exists": False, "size": None, "md5": None}
    size = path.stat().st_size
    digest = hashlib.md5(path.read_bytes(), usedforsecurity=False).hexdigest() if size < MD5_BELOW else None
    return {"path": name, "exists": True, "size": size, "md5": digest}


def verify(out: str | Path) -> dict:
    """Version, existence, size and md5 of what the manifest lists."""
    out = Path(out)
    manifest = json.loads((out / "manifest.json").read_text(encoding="utf-8"))
    major, minor = (int(x) for x in VERSION.split("."))
    try:
        a, b = (int(x) for x in (str(manifest["version"]).split(".") + ["0"])[:2])
        version = "mismatch" if a != major or b > minor else "warning" if b < minor else "ok"
    except (ValueError, KeyError):
        version = "mismatch"
    problems = []
    for e in manifest["files"]:
        now = file_entry(out, e["path"])
        problems += [{"path": e["path"], "problem": k} for k in ("exists", "size", "md5") if e[k] is not None and now[k] != e[k]][:1]
    return {"ok": version != "mismatch" and not problems, "version": version, "problems": problems}


# --- The run ------------------------------------------------------------------------------------------------


def run(spark: SparkSession, project_dir: str, output_dir: str, overrides: dict | None = None) -> dict:
    """Runs the four stages and gives the summary that is also written."""
    settings, out, took = S.load(project_dir, overrides), Path(output_dir), {}
    logging_to(out)
    epsg, rules, began = S.srs(settings), rule_table(spark), time.time()
    if not settings["has_file"]:
        log.warning("no project.json: defaults are used")

    def done(stage: str) -> None:
        nonlocal began
        took[stage], began = round(time.time() - began, 2), time.time()
        log.info("%s in %s s", stage, took[stage])

    found, errors = features(spark, project_dir)
    read = ingest.parse_layers(found)
    m0 = out / "m0"
    write_layer(read.select("fid", "kind", "parts", F.map_from_arrays(F.transform(F.map_keys("attrs"), lambda k: F.concat(F.lit("attr_"), k)), F.map_values("attrs")).alias("attrs"), "layer", "folder", "base_level2", "canonical_level2", "variant", "level1", "resolution_path"), m0, "unified_vectors", epsg)
    inventory = ingest.variant_inventory(read)
    files.save_json([r.asDict(True) for r in inventory.collect()], m0 / "variant_inventory.json")
    files.save_json([r.asDict(True) for r in ingest.protection_coverage(inventory, rules).collect()], m0 / "protection_coverage_report.json")
    rasters = vector.raster_inventory(spark, project_dir).withColumn("kind", ingest.raster_type(F.col("path")))
    rasters = [r.asDict(True) for r in rasters.collect()]
    files.save_json(rasters, m0 / "raster_inventory.json")
    control = controls(spark, project_dir, settings)
    files.save_json({k: control.get(k, []) for k in CONTROLS}, m0 / "control_objects.json")
    files.save_json({"unreadable": [r.asDict() for r in errors.collect()], "controls_absent": [k for k in CONTROLS if k not in control]}, m0 / "read_log.json")
    done("m0")

    m1 = out / "m1"
    stored = spark.read.parquet(f"{m0}/unified_vectors.parquet").filter("NOT _placeholder").drop("_placeholder")
    bare = F.map_from_arrays(F.transform(F.map_keys("attrs"), lambda k: F.substring(k, F.lit(6), F.length(k))), F.map_values("attrs"))
    standard = standardise(stored.select("fid", "kind", "parts", bare.alias("attrs"), "layer", "folder", F.lit(None).cast("string").alias("dataset")))
    write_layer(standard.select("fid", "kind", "parts", "layer", "folder", "variant", "std_level1", "std_level2", "std_rule_id", "mapping_method", "mapping_confidence", "raw_level1", "raw_level2"), m1, "standardized_features", epsg)
    standard = spark.read.parquet(f"{m1}/standardized_features.parquet").filter("NOT _placeholder").withColumn("level1", F.col("std_level1")).withColumn("level2", F.col("std_level2"))
    methods = {r["mapping_method"]: r["n"] for r in standard.groupBy("mapping_method").agg(F.count("*").alias("n")).collect()}
    files.save_json({"features": sum(methods.values()), "methods": methods}, m1 / "semantic_mapping_report.json")
    files.save_json([r.asDict() for r in classify.review_candidates(standard).limit(500).collect()], m1 / "unmapped_features_preview.json")
    done("m1")

    m2, counts = out / "m2", {}
    layers = geometry_layers(standard, rules, settings)
    fixes = layers.pop("geometry_fixes")
    files.save_json([r.asDict() for r in fixes.collect()], m2 / "geometry_fixes_log.json")
    for name, df in layers.items():
        counts[name] = write_layer(df, m2, name, epsg, areas=name.endswith("polygons"))
    files.save_json({k: control.get(k, []) for k in CONTROLS}, m2 / "control_objects.json")
    zone = wind_ice_vector(project_dir) if not settings["flags"]["disable_wind_ice"] else None
    raster_zone = next((r["path"] for r in rasters if r["kind"] == "WIND_ICE_ZONE" and r["error"] is None), None)
    wind_ice = "disabled" if settings["flags"]["disable_wind_ice"] else "raster" if raster_zone else "vector+global" if zone else "global"
    done("m2")

    m3 = out / "m3"
    stored_layers = {n: spark.read.parquet(f"{m2}/{n}.parquet").filter("NOT _placeholder") for n in counts}
    box, origin = work_box(settings, control, spark.read.parquet(f"{m0}/unified_vectors.parquet").filter("NOT _placeholder"), rasters)
    files.save_json([r.asDict(True) for r in QUERIES["rule_compile"](spark, project_dir).collect()], m3 / "rule_config.json")
    files.save_json(settings["solver_params"], m3 / "solver_params.json")
    ends = placed(control, "start_end")
    files.save_json({"bbox": box, "bbox_origin": origin, "working_crs": settings["working_crs"], "resolution_m": settings["resolution_m"], "start": ends[0] if ends else None, "end": ends[-1] if len(ends) > 1 else None}, m3 / "workspace.json")
    flags = settings["flags"]
    emitted = []
    if flags["emit_unconsumed_outputs"]:
        for suffix, res in [("coarse", settings["resolution_m"])] + ([("fine", settings["resolution_m"] / 2)] if flags["emit_fine"] else []):
            emitted.append(raster_fields(spark, stored_layers, box, float(res), wind_ice_combination(spark, settings), m3, suffix, epsg))
    nav = "skip" if not flags["emit_unconsumed_outputs"] else settings["solver_params"]["nav_graph_mode"]
    files.save_json({"build_mode": nav, "status": "skipped" if nav == "skip" else "deferred", "nodes": 0, "edges": 0}, m3 / "nav_graph_meta.json")
    dem = next((r for r in rasters if r["kind"] == "DEM" and r["error"] is None), None)
    dem_state = spark.range(1).select(gates.dem_quality(F.lit(dem["res_x"] if dem else None).cast("double"), F.lit(0.0), F.lit(False)).alias("q")).first().q
    row = spark.createDataFrame([(not flags["disable_river"], wind_ice != "global", dem_state, origin != "default", sum(counts[n] for n in SINKS.values()), "none", nav, "deferred", 0, 0, True)], "river_ok boolean, wind_ok boolean, dem string, bbox_ok boolean, n_polygons long, runtime string, build_mode string, nav_status string, nodes long, edges long, connected boolean")
    stage = gates.delivery(row).select("level", "severe", "preliminary").first().asDict()
    files.save_json(stage, m3 / "delivery_level.json")
    files.save_json({"layers": counts, "fixes": fixes.count(), "wind_ice_mode": wind_ice, "rasters": emitted, "dem": dem_state}, m3 / "preprocessing_report.json")
    done("m3")

    needed = spark.range(1).select(gates.required_files(F.lit(flags["emit_unconsumed_outputs"]), F.lit(flags["emit_fine"])).alias("f")).first().f + [f"m2/{n}.gpkg" for n in (*SINKS.values(), "linear_cross_indexed", "preferred_corridors")]
    listed = sorted({str(p.relative_to(out)) for p in out.rglob("*") if p.is_file() and p.suffix in (".json", ".gpkg", ".tif")} | set(needed))
    entries = [file_entry(out, n) for n in listed if n != "manifest.json"]
    missing = [e["path"] for e in entries if not e["exists"]]
    view = spark.createDataFrame([(dem_state, bool(flags["allow_planar_2d_mode"]), missing)], "dem string, planar boolean, missing_files array<string>")
    package = gates.severity(view).withColumn("mode", gates.operational_mode(F.col("dem"), F.col("planar"))).select("level", "severe", "preliminary", "mode").first().asDict()
    worst = max((stage["level"], package["level"]), key=["FORMAL_DELIVERY", "PRELIMINARY_ROUTE_ONLY", "SEVERE_DEGRADED"].index) if not flags["allow_planar_2d_mode"] else package["level"]
    manifest = {"version": VERSION, "created": datetime.now().isoformat(timespec="seconds"), "project": settings["project_name"], "delivery_level": worst, "operational_mode": package["mode"], "stage_level": stage["level"], "missing": missing, "files": entries, "solver_param_keys": sorted(settings["solver_params"]), "rule_count": rules.count(), "timings": took, "nav_graph": nav}
    files.save_json(manifest, out / "manifest.json")
    summary = {"output_dir": str(out), "layers": counts, "methods": methods, "delivery_level": worst, "timings": took, "verified": verify(out)}
    files.save_json(summary, out / "preprocessing_summary.json")
    return summary


def work_box(settings: dict, control: dict, vectors: DataFrame, rasters: list[dict]) -> tuple[dict, str]:
    """The first of: settings; start, end and what must be passed, with 5 km; the latter alone; vectors and 5 %; the DEM and 5 %; a default."""
    names = ("xmin", "ymin", "xmax", "ymax")
    if settings.get("bbox"):
        return dict(zip(names, map(float, settings["bbox"]), strict=True)), "config"
    must = [p for k in ("must_pass", "must_path") for p in placed(control, k)]
    for points, name in ((placed(control, "start_end") and placed(control, "start_end") + must, "start_end"), (must, "must_pass")):
        if points:
            xs, ys = zip(*points, strict=True)
            return dict(zip(names, (min(xs) - 5000, min(ys) - 5000, max(xs) + 5000, max(ys) + 5000), strict=True)), name
    xy = F.flatten("parts")
    v = vectors.agg(F.min(F.array_min(xy["x"])).alias("xmin"), F.min(F.array_min(xy["y"])).alias("ymin"), F.max(F.array_max(xy["x"])).alias("xmax"), F.max(F.array_max(xy["y"])).alias("ymax")).first()
    dem = next((r for r in rasters if r["kind"] == "DEM" and r["error"] is None), None)
    found = [(v.asDict(), "vectors")] if v.xmin is not None else []
    if dem:
        found.append(({"xmin": dem["xmin"], "ymax": dem["ymax"], "xmax": dem["xmin"] + dem["width"] * dem["res_x"], "ymin": dem["ymax"] - dem["height"] * dem["res_y"]}, "dem"))
    for b, name in found:
        dx, dy = max(b["xmax"] - b["xmin"], 100) * 0.05, max(b["ymax"] - b["ymin"], 100) * 0.05
        return {"xmin": b["xmin"] - dx, "ymin": b["ymin"] - dy, "xmax": b["xmax"] + dx, "ymax": b["ymax"] + dy}, name
    return dict(zip(names, (0.0, 0.0, 50000.0, 50000.0), strict=True)), "default"


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--project_dir", required=True)
    p.add_argument("--output_dir")
    p.add_argument("--working_crs")
    p.add_argument("--voltage_kv", type=int)
    p.add_argument("--resolution_m", type=float)
    for flag in S.DEFAULTS["flags"]:
        p.add_argument(f"--{flag}", action="store_true")
    a = p.parse_args(argv)
    given = {k: v for k, v in vars(a).items() if k in ("working_crs", "voltage_kv", "resolution_m") and v is not None}
    flags = {k: True for k in S.DEFAULTS["flags"] if getattr(a, k)}  # a switch overrides only when it is passed
    out = a.output_dir or str(Path(a.project_dir) / "output" / datetime.now().strftime("run_%Y%m%d_%H%M%S"))
    return run(SparkSession.builder.getOrCreate(), a.project_dir, out, given | ({"flags": flags} if flags else {}))


if __name__ == "__main__":
    main()
