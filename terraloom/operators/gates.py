"""Quality gates: reasons as codes, levels from reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIGS = ["m3/rule_config.json", "m3/solver_params.json", "m3/workspace.json", "m3/delivery_level.json"]
COARSE = ["m3/forbidden_mask_coarse.tif", "m3/tower_mask_coarse.tif", "m3/lpcf_coarse.tif", "m3/tscf_coarse.tif"]
FINE = [x.replace("coarse", "fine") for x in COARSE]


def level(severe: Column, preliminary: Column) -> Column:
    return F.when(F.size(severe) > 0, "SEVERE_DEGRADED").when(F.size(preliminary) > 0, "PRELIMINARY_ROUTE_ONLY").otherwise("FORMAL_DELIVERY")


def codes(**tests: Column) -> Column:
    """Array of the names whose test holds, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))


def dem_quality(res: Column, nodata: Column, severe: Column) -> Column:
    """missing (no resolution known), severe as flagged upstream, coarse beyond 30 m, holes beyond 5 %, or ok."""
    return F.when(res.isNull(), "missing").when(F.coalesce(severe, F.lit(False)), "severe").when(res > 30, "coarse").when(nodata > 0.05, "holes").otherwise("ok")


def delivery(cases: DataFrame) -> DataFrame:
    """Stage view of the delivery level over river_ok, wind_ok, dem, bbox_ok, n_polygons, runtime severity, and the navigation graph."""
    c = F.col
    on = c("build_mode") == "immediate"
    failed, few, none = on & c("nav_status").isin("skipped", "failed"), c("nodes") < 10, c("edges") == 0
    severe = codes(
        DEM_SEVERE=c("dem").isin("missing", "severe"), BBOX=~c("bbox_ok"), EMPTY_LAYERS=c("n_polygons") == 0, RUNTIME=c("runtime") == "severe", NAV_STATUS=failed, NAV_FEW_NODES=on & ~failed & few,
        NAV_NO_EDGES=on & ~failed & ~few & none, NAV_DISCONNECTED=on & ~failed & ~few & ~none & ~c("connected"),
    )
    preliminary = codes(RIVER=~c("river_ok"), WIND_ICE=~c("wind_ok"), DEM_DEGRADED=c("dem").isin("coarse", "holes"), RUNTIME_DEGRADED=c("runtime") == "degraded", NAV_SPARSE=on & ~failed & ~few & ~none & c("connected") & (c("edges") < c("nodes") * 0.5))
    return cases.withColumn("severe", severe).withColumn("preliminary", preliminary).withColumn("level", level(c("severe"), c("preliminary")))


def severity(cases: DataFrame) -> DataFrame:
    """Package view: stage reasons with missing files; planar mode turns a missing DEM from severe to preliminary, not a DEM that is wrong."""
    c = F.col
    soft = c("planar") & (c("dem") == "missing")
    core = F.exists("missing_files", lambda f: f.rlike("^m3/(forbidden_mask|tower_mask|lpcf|tscf)_") | (f == "m2/forbidden_polygons.gpkg"))
    other = F.exists("missing_files", lambda f: ~(f.rlike("^m3/(forbidden_mask|tower_mask|lpcf|tscf)_") | (f == "m2/forbidden_polygons.gpkg")))
    severe = codes(DEM_MISSING=(c("dem") == "missing") & ~c("planar"), DEM_SEVERE=c("dem") == "severe", CORE_MISSING=core)
    preliminary = codes(DEM_PLANAR=soft, DEM_DEGRADED=c("dem").isin("coarse", "holes"), FILES_MISSING=other)
    return cases.withColumn("severe", severe).withColumn("preliminary", preliminary).withColumn("level", level(c("severe"), c("preliminary")))


def operational_mode(dem: Column, planar: Column) -> Column:
    usable = ~dem.isin("missing", "severe")
    return F.when(usable, "3D").when(planar, "2D_PLANAR").otherwise("UNAVAILABLE")


def required_files(emit: Column, fine: Column) -> Column:
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.when(emit & fine, lit(CONFIGS + COARSE + FINE)).when(emit, lit(CONFIGS + COARSE)).otherwise(lit(CONFIGS))


def nav_mode(emit: Column, mode: Column) -> Column:
    return F.when(~emit, "skip").otherwise(F.coalesce(mode, F.lit("skip")))


def version_check(expected: str, actual: Column) -> Column:
    """ok, warning (older minor), or mismatch (newer minor, other major, unreadable)."""
    major, minor = (int(x) for x in expected.split("."))
    a = F.regexp_extract(actual, r"^(\d+)(?:\.(\d+))?", 1).try_cast("int")
    b = F.coalesce(F.nullif(F.regexp_extract(actual, r"^(\d+)(?:\.(\d+))?", 2), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(a.isNull() | (a != major) | (b > minor), "mismatch").when(b < minor, "warning").otherwise("ok")


def verify_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries (path, exists, size) of a manifest against the files found (path, size)."""
    found = listing.select("path", F.col("size").alias("_found"))
    status = F.when(F.col("exists") != F.col("_found").isNotNull(), "existence").when(F.col("exists") & F.col("size").isNotNull() & (F.col("size") != F.col("_found")), "size").otherwise("ok")
    return manifest.join(found, "path", "left").withColumn("status", status).drop("_found")
