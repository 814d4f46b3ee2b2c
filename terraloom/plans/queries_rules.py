"""Queries over the rule table and the routing of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import cost
from terraloom.functions.geometry import rectangle_ring, ring_area
from terraloom.operators import route
from terraloom.plans.registry import query

R = ("rules",)
_BASE = "CASE WHEN cost_type = 'forbidden' THEN 999999.0 WHEN cost_type IN ('angle_formula', 'length_formula') AND base IS NOT NULL THEN base WHEN cross_num IS NOT NULL THEN cross_num WHEN cross_text LIKE '%禁止%' THEN 999999.0 ELSE 0.0 END"
_LAND = "CASE WHEN land_num IS NOT NULL THEN land_num WHEN land_text LIKE '%禁止%' THEN 999999.0 ELSE 0.0 END"
_RANGE = "CASE WHEN range_m > 0 THEN range_m WHEN reward > 0 THEN 200 ELSE 0 END"
_FAMILY = """CASE WHEN level1 IN ('交通敏感点', '电力设施敏感点', '管廊敏感点') THEN (CASE WHEN rule_id IN (32, 54, 55, 56) THEN 'polygon' ELSE 'line' END)
 WHEN level1 = '河流' THEN 'line' WHEN level1 = '地形' THEN 'raster' WHEN buffer_m > 0 AND rule_id BETWEEN 23 AND 31 THEN 'point' ELSE 'polygon' END"""
_BEHAVIOR = """CASE WHEN NOT enter AND NOT may_cross THEN 'FORBIDDEN_AREA' WHEN min_angle > 0 THEN 'LINEAR_CROSS_CONTROL' WHEN NOT land THEN 'NO_TOWER_AREA' WHEN reward > 0 THEN 'PREFERRED_CORRIDOR'
 WHEN cost_type IN ('angle_formula', 'length_formula') OR land_num > 0 OR cross_num > 0 THEN 'HIGH_COST_AREA' ELSE 'NORMAL' END"""


@query("rules_scan", 'SELECT rule_id, level1, level2, buffer_m, min_angle, reward, range_m, enter, land, may_cross AS cross_ok, cost_type, land_num, cross_num FROM rules', R)
def _(c):
    return c.rules.select("rule_id", "level1", "level2", "buffer_m", "min_angle", "reward", "range_m", "enter", "land", F.col("may_cross").alias("cross_ok"), "cost_type", "land_num", "cross_num")


@query("formula_fields", "SELECT rule_id, base, k_angle, k_km FROM rules WHERE base IS NOT NULL", R)
def _(c):
    return c.rules.filter("base IS NOT NULL").select("rule_id", "base", "k_angle", "k_km")


@query("land_cost", f"SELECT rule_id, CAST({_LAND} AS DOUBLE) AS land_cost FROM rules", R)
def _(c):
    return c.rules.select("rule_id", cost.land_cost().alias("land_cost"))


@query("base_cross_cost", f"SELECT rule_id, CAST({_BASE} AS DOUBLE) AS base_cost FROM rules", R)
def _(c):
    return c.rules.select("rule_id", cost.base_cross_cost().alias("base_cost"))


@query(
    "cross_cost_eval",
    f"""SELECT rule_id, a AS angle, l AS length_km, round(CASE WHEN cost_type = 'angle_formula' THEN base + k_angle * cos(radians(greatest(0.0, least(90.0, a)))) WHEN cost_type = 'length_formula' THEN base + k_km * l ELSE {_BASE} END, 4) AS cost
    FROM rules CROSS JOIN (SELECT * FROM (VALUES (CAST(60 AS DOUBLE), CAST(2.5 AS DOUBLE)), (CAST(90 AS DOUBLE), CAST(0 AS DOUBLE)), (CAST(120 AS DOUBLE), CAST(1.25 AS DOUBLE)), (CAST(-5 AS DOUBLE), CAST(10 AS DOUBLE))) AS q(a, l)) q""",
    R,
)
def _(c):
    asked = c.spark.createDataFrame([(60.0, 2.5), (90.0, 0.0), (120.0, 1.25), (-5.0, 10.0)], "angle double, length_km double")
    return c.rules.crossJoin(F.broadcast(asked)).select("rule_id", "angle", "length_km", F.round(cost.cross_cost(F.col("angle"), F.col("length_km")), 4).alias("cost"))


@query("one_time_cost", "SELECT rule_id, CASE WHEN cost_type = 'forbidden' THEN false WHEN cost_type <> 'fixed' THEN true ELSE coalesce(cross_num, 0) > 0 OR coalesce(land_num, 0) > 0 END AS one_time FROM rules", R)
def _(c):
    return c.rules.select("rule_id", cost.one_time().alias("one_time"))


@query("parallel_range", f"SELECT rule_id, CAST({_RANGE} AS INT) AS range_out FROM rules", R)
def _(c):
    return c.rules.select("rule_id", cost.parallel_range().cast("int").alias("range_out"))


@query("cost_decompose", "SELECT rule_id, coalesce(CASE WHEN cost_type LIKE '%formula' THEN base ELSE cross_num END, 0) AS cross_cost, coalesce(k_angle, 0) AS cross_cost_angle_coeff, coalesce(k_km, 0) AS cross_cost_per_km, coalesce(land_num, 0) AS tower_cost FROM rules", R)
def _(c):
    return c.rules.select("rule_id", *[x.alias(k) for k, x in cost.numeric_parts().items()])


@query("voltage_kv", "SELECT rule_id, coalesce(try_cast(nullif(regexp_extract(level2, '(?i)(\\d+)\\s*kV', 1), '') AS INT), 0) AS kv FROM rules", R)
def _(c):
    return c.rules.select("rule_id", cost.voltage_kv(F.col("level2")).alias("kv"))


@query("geometry_family", f"SELECT rule_id, {_FAMILY} AS family FROM rules", R)
def _(c):
    return c.rules.select("rule_id", cost.geometry_family().alias("family"))


@query("rule_behavior", f"SELECT rule_id, {_BEHAVIOR} AS behavior FROM rules", R)
def _(c):
    return c.rules.select("rule_id", cost.behavior().alias("behavior"))


@query(
    "rule_compile",
    f"""SELECT rule_id, level1, level2, enter AS is_enterable, land AS is_landable, may_cross AS cross_allow, coalesce(land_text, CAST(CAST(land_num AS INT) AS VARCHAR)) AS land_cost, coalesce(cross_text, CAST(CAST(cross_num AS INT) AS VARCHAR)) AS cross_cost_expr, cost_type,
    base, k_angle, k_km, buffer_m AS buffer_dist_m, min_angle AS min_cross_angle_deg, reward AS parallel_reward, CAST({_RANGE} AS INT) AS parallel_range_m,
    coalesce(CASE WHEN cost_type LIKE '%formula' THEN base ELSE cross_num END, 0) AS cross_cost, coalesce(k_angle, 0) AS cross_cost_angle_coeff, coalesce(k_km, 0) AS cross_cost_per_km, coalesce(land_num, 0) AS tower_cost, {_FAMILY} AS geometry_family, {_BEHAVIOR} AS compiled_behavior FROM rules""",
    R,
)
def _(c):
    text = lambda t, n: F.coalesce(t, F.col(n).cast("int").cast("string"))
    return c.rules.select(
        "rule_id", "level1", "level2", F.col("enter").alias("is_enterable"), F.col("land").alias("is_landable"), F.col("may_cross").alias("cross_allow"), text("land_text", "land_num").alias("land_cost"), text("cross_text", "cross_num").alias("cross_cost_expr"), "cost_type",
        "base", "k_angle", "k_km", F.col("buffer_m").alias("buffer_dist_m"), F.col("min_angle").alias("min_cross_angle_deg"), F.col("reward").alias("parallel_reward"), cost.parallel_range().cast("int").alias("parallel_range_m"),
        *[x.alias(k) for k, x in cost.numeric_parts().items()], cost.geometry_family().alias("geometry_family"), cost.behavior().alias("compiled_behavior"),
    )


@query(
    "config_layering",
    "SELECT * FROM (VALUES ('crs', 'EPSG:4547'), ('voltage', '500'), ('ice', '20'), ('wind', 'C'), ('fine', 'true')) AS t(k, v)",
)
def _(c):
    layer = lambda **kw: F.create_map(*[F.lit(x) for p in kw.items() for x in p])
    merged = F.map_from_entries(F.array_sort(F.map_entries(last_wins(layer(crs="EPSG:4490", voltage="500", ice="10", wind="B", fine="false"), layer(crs="EPSG:4547", ice="20"), layer(wind="C", fine="true")))))
    return c.spark.range(1).select(F.explode(merged).alias("k", "v"))


def last_wins(*maps):
    """Maps merged so that a later one overrides an earlier one, whatever the session's policy on repeated keys."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(_without_keys(out, m), m)
    return out


def _without_keys(out, later):
    return F.map_filter(out, lambda k, _: ~F.array_contains(F.map_keys(later), k))


@query("wind_ice_combo", "SELECT w.wind_zone, i.ice_zone, z.zone_code, z.tower_mult, z.line_mult FROM (SELECT wind_zone FROM zones) w CROSS JOIN (SELECT ice_zone FROM zones) i LEFT JOIN zones z ON z.wind_zone = w.wind_zone AND z.ice_zone = i.ice_zone", ("zones",))
def _(c):
    asked = c.zones.select("wind_zone").crossJoin(F.broadcast(c.zones.select("ice_zone")))
    return asked.join(F.broadcast(c.zones.select("wind_zone", "ice_zone", "zone_code", "tower_mult", "line_mult")), ["wind_zone", "ice_zone"], "left")


_CASES = f"""x AS (SELECT p.fid, p.variant, p.xmin, p.ymin, p.xmax, p.ymax, r.rule_id, r.level1, r.level2, r.enter, r.land, r.may_cross AS xok, r.base, r.cost_type, {_LAND} AS lc0, {_BASE} AS cc0 FROM v_poly p JOIN rules r ON r.rule_id = p.rule_id)"""
_PRIMARY = "SELECT fid, rule_id, 'F' AS sink FROM x WHERE variant = 'primary' AND NOT enter AND NOT xok UNION ALL SELECT fid, rule_id, 'N' FROM x WHERE variant = 'primary' AND (enter OR xok) AND (NOT land OR lc0 >= 999999) UNION ALL SELECT fid, rule_id, 'C' FROM x WHERE variant = 'primary' AND (enter OR xok) AND ((lc0 > 0 AND lc0 < 999999) OR (cc0 > 0 AND cc0 < 999999))"
_PROTECT = "SELECT fid, rule_id, 'F' AS sink FROM x WHERE variant = 'protection' AND (NOT xok OR cc0 >= 999999) UNION ALL SELECT fid, rule_id, 'N' FROM x WHERE variant = 'protection' AND (NOT land OR lc0 >= 999999) UNION ALL SELECT fid, rule_id, 'C' FROM x WHERE variant = 'protection' AND ((lc0 > 0 AND lc0 < 999999) OR (cc0 > 0 AND cc0 < 999999) OR base IS NOT NULL)"
PR = ("rules", "poly")


@query("route_primary", f"WITH {_CASES} {_PRIMARY}", PR)
def _(c):
    return route.route(c.poly.filter("variant = 'primary'"), c.rules).select("fid", "rule_id", "sink")


@query("route_protection", f"WITH {_CASES} {_PROTECT}", PR)
def _(c):
    return route.route(c.poly.filter("variant = 'protection'"), c.rules).select("fid", "rule_id", "sink")


@query("sink_totals", f"WITH {_CASES}, s AS ({_PRIMARY} UNION ALL {_PROTECT}) SELECT s.sink, s.rule_id, count(*) AS n, round(sum((xmax - xmin) * (ymax - ymin)), 1) AS area_m2 FROM s JOIN x ON x.fid = s.fid GROUP BY s.sink, s.rule_id", PR)
def sink_totals(c):
    area = ring_area(rectangle_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))
    return route.route(c.poly, c.rules).withColumn("a", area).groupBy("sink", "rule_id").agg(F.count("*").alias("n"), F.round(F.sum("a"), 1).alias("area_m2"))


@query("processed_polygons", f"WITH {_CASES} SELECT fid, rule_id, variant, level1 = '生态敏感点' AS is_eco FROM x WHERE variant <> 'reward'", PR)
def _(c):
    return c.poly.withColumn("variant", route.normal_variant(F.col("variant"))).filter("variant <> 'reward'").join(F.broadcast(c.rules.select("rule_id", "level1")), "rule_id").select("fid", "rule_id", "variant", (F.col("level1") == "生态敏感点").alias("is_eco"))


@query("variant_norm", "SELECT fid, CASE WHEN fid % 4 = 0 THEN 'primary' WHEN fid % 4 = 1 THEN 'primary' ELSE variant END AS variant, count(*) FILTER (WHERE fid % 4 = 1) OVER () AS n_unknown FROM v_poly", ("poly",))
def _(c):
    raw = c.poly.withColumn("v", F.when(F.col("fid") % 4 == 0, F.lit(None)).when(F.col("fid") % 4 == 1, "buffer").otherwise(F.col("variant")))
    odd = raw.filter("v IS NOT NULL AND v NOT IN ('primary', 'protection', 'reward')").agg(F.count("*").alias("n_unknown"))
    return raw.select("fid", route.normal_variant(F.col("v")).alias("variant")).crossJoin(F.broadcast(odd))


_FEATURES = "f AS (SELECT fid, CASE fid % 4 WHEN 0 THEN -1 ELSE rule_id END AS std_rule_id, CASE fid % 8 WHEN 0 THEN 'UNKNOWN' WHEN 4 THEN '国道' WHEN 5 THEN '  ' WHEN 6 THEN NULL ELSE '原名' END AS std_level2 FROM v_poly)"


def _features(c):
    name = F.when(F.col("fid") % 8 == 0, "UNKNOWN").when(F.col("fid") % 8 == 4, "国道").when(F.col("fid") % 8 == 5, "  ").when(F.col("fid") % 8 == 6, F.lit(None)).otherwise("原名")
    return c.poly.select("fid", F.when(F.col("fid") % 4 == 0, -1).otherwise(F.col("rule_id")).alias("std_rule_id"), name.alias("std_level2"))


@query("join_rule_fallback", f"WITH {_FEATURES} SELECT f.fid, coalesce(a.rule_id, b.rule_id) AS used_rule FROM f LEFT JOIN rules a ON a.rule_id = f.std_rule_id LEFT JOIN rules b ON b.level2 = f.std_level2 WHERE coalesce(a.rule_id, b.rule_id) IS NOT NULL", PR)
def _(c):
    return route.with_rule(_features(c), c.rules).select("fid", F.col("rule.rule_id").alias("used_rule"))


@query("safe_level2", f"WITH {_FEATURES} SELECT f.fid, coalesce(nullif(trim(f.std_level2), ''), coalesce(a.level2, b.level2)) AS level2 FROM f LEFT JOIN rules a ON a.rule_id = f.std_rule_id LEFT JOIN rules b ON b.level2 = f.std_level2 WHERE coalesce(a.rule_id, b.rule_id) IS NOT NULL", PR)
def _(c):
    return route.with_rule(_features(c), c.rules).select("fid", route.safe_level2(F.col("std_level2"), F.col("rule.level2")).alias("level2"))


@query("critical_infra", "SELECT CASE WHEN r.level2 IN ('变电站', '换流站', '接地极') THEN r.level2 ELSE '其他' END AS kind, count(*) AS n FROM v_point p JOIN rules r ON r.rule_id = p.rule_id WHERE r.level2 IN ('变电站', '换流站', '接地极') OR r.cost_type = 'forbidden' GROUP BY 1", ("rules", "point"))
def _(c):
    kind = F.when(F.col("level2").isin("变电站", "换流站", "接地极"), F.col("level2")).when(F.col("cost_type") == "forbidden", "其他")
    return c.point.join(F.broadcast(c.rules), "rule_id").select(kind.alias("kind")).filter("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


@query("linear_eligible", f"SELECT l.fid, r.rule_id FROM v_line l JOIN rules r ON r.rule_id = l.rule_id WHERE r.min_angle IS NOT NULL OR {_BASE} > 0", ("rules", "line"))
def _(c):
    return c.line.join(F.broadcast(c.rules), "rule_id").filter(F.col("min_angle").isNotNull() | (cost.base_cross_cost() > 0)).select("fid", "rule_id")


@query("split_by_gtype", "SELECT family, count(*) AS n FROM (SELECT CASE fid % 7 WHEN 0 THEN 'point' WHEN 1 THEN 'point' WHEN 2 THEN 'line' WHEN 3 THEN 'line' WHEN 4 THEN 'polygon' WHEN 5 THEN 'polygon' END AS family FROM v_poly) t WHERE family IS NOT NULL GROUP BY family", ("poly",))
def _(c):
    kinds = F.array(*[F.lit(x) for x in ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")])
    typed = c.poly.select(F.element_at(kinds, (F.col("fid") % 7 + 1).cast("int")).alias("gtype"))
    return typed.select(family(F.col("gtype")).alias("family")).filter("family IS NOT NULL").groupBy("family").agg(F.count("*").alias("n"))


def family(gtype):
    """point, line or polygon; other kinds, such as collections, belong to none."""
    return F.when(gtype.isin("Point", "MultiPoint"), "point").when(gtype.isin("LineString", "MultiLineString"), "line").when(gtype.isin("Polygon", "MultiPolygon"), "polygon")


@query("polygon_area", "SELECT fid, round((xmax - xmin) * (ymax - ymin), 1) AS area_m2 FROM v_poly", ("poly",))
def _(c):
    return c.poly.select("fid", F.round(ring_area(rectangle_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))), 1).alias("area_m2"))


@query("polygon_sink_area", "SELECT fid, area_m2, placeholder FROM (SELECT fid, round((xmax - xmin) * (ymax - ymin), 1) AS area_m2, false AS placeholder FROM v_poly WHERE rule_id = 64) a UNION ALL SELECT -1, 0.0, true WHERE NOT EXISTS (SELECT 1 FROM v_poly WHERE rule_id = 64)", ("poly",))
def _(c):
    own = c.poly.filter("rule_id = 64").select("fid", F.round(ring_area(rectangle_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))), 1).alias("area_m2"), F.lit(False).alias("placeholder"))
    return or_placeholder(own, c.spark.createDataFrame([(-1, 0.0, True)], own.schema))


def or_placeholder(rows, placeholder):
    """rows, or the placeholder if there are none, without collecting anything."""
    none = rows.limit(1).agg(F.count("*").alias("_n")).filter("_n = 0")
    return rows.unionByName(placeholder.crossJoin(F.broadcast(none)).drop("_n"))


@query("report_counts", f"WITH {_CASES}, s AS ({_PRIMARY} UNION ALL {_PROTECT}) SELECT sink, count(*) AS n, count(DISTINCT rule_id) AS rules_used FROM s GROUP BY sink", PR)
def _(c):
    return route.route(c.poly, c.rules).groupBy("sink").agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("rules_used"))
