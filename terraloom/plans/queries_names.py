"""Queries over names: layers, folders, districts and the classification of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import classify, ingest
from terraloom.plans.registry import query
from terraloom.storage import table

RL = ("rules", "lookups")
LY = ("layer",)
_RE = "'^(.+?)(_(?:保护|奖励|缓冲|河道)范围)?$'"
_KW = "kw AS (SELECT position, phrase, coalesce(r.level1, means) AS l1, coalesce(r.level2, '') AS l2 FROM lookups LEFT JOIN rules r ON CAST(r.rule_id AS VARCHAR) = means WHERE kind = 'folder')"
_PATH = f"""{_KW}, pt AS (SELECT DISTINCT folder FROM v_layer), pp AS (SELECT folder, unnest(str_split(folder, '/')) AS part, generate_subscripts(str_split(folder, '/'), 1) AS depth FROM pt),
hit AS (SELECT folder, depth, l1, l2, row_number() OVER (PARTITION BY folder, depth ORDER BY part <> phrase, position) AS rk FROM pp JOIN kw ON contains(part, phrase) WHERE NOT regexp_matches(part, '(\\.gdb|\\.shp)$|^\\d+$')),
pc AS (SELECT pt.folder, coalesce(arg_max(l1, depth), '') AS l1, coalesce(arg_max(l2, depth) FILTER (WHERE l2 <> ''), '') AS l2 FROM pt LEFT JOIN hit ON hit.folder = pt.folder AND rk = 1 GROUP BY pt.folder)"""
_PARSED = f"""{_PATH}, b AS (SELECT fid, layer, folder, dataset, regexp_extract(layer, {_RE}, 1) AS bn, regexp_extract(layer, {_RE}, 2) AS sfx FROM v_layer),
al AS (SELECT phrase, r.level2 AS canon FROM lookups JOIN rules r ON CAST(r.rule_id AS VARCHAR) = means WHERE kind = 'alias'), ds AS (SELECT phrase, means FROM lookups WHERE kind = 'dataset'),
pr AS (SELECT b.fid, b.layer, b.folder, bn AS base_level2, coalesce(al.canon, bn) AS canonical_level2, CASE WHEN sfx = '_奖励范围' THEN 'reward' WHEN sfx <> '' THEN 'protection' ELSE 'primary' END AS variant,
coalesce(r.level1, ds.means, pc.l1) AS level1, CASE WHEN r.level1 IS NOT NULL THEN 'rule_table_lookup' WHEN ds.means IS NOT NULL THEN 'feature_dataset_probe' WHEN pc.l1 <> '' THEN 'path_inference' ELSE 'unresolved' END AS resolution_path
FROM b LEFT JOIN al ON al.phrase = bn LEFT JOIN rules r ON r.level2 = coalesce(al.canon, bn) LEFT JOIN ds ON ds.phrase = b.dataset JOIN pc ON pc.folder = b.folder)"""


def _parsed(c):
    return ingest.parse_layers(c.layer)


@query("layer_parse", f"WITH {_PARSED} SELECT fid, base_level2, canonical_level2, variant, level1, resolution_path FROM pr", LY)
def _(c):
    return _parsed(c).select("fid", "base_level2", "canonical_level2", "variant", "level1", "resolution_path")


@query("path_category", f"WITH {_PATH} SELECT folder, l1, l2 FROM pc", LY)
def _(c):
    l1, l2 = ingest.folder_match(F.col("folder"))
    return c.layer.select("folder").distinct().select("folder", l1.alias("l1"), l2.alias("l2"))


@query("district_extract", "SELECT DISTINCT folder, coalesce(nullif(regexp_extract(coalesce(str_split(folder, '/')[-2], ''), '(\\d{6})', 1), ''), regexp_extract(folder, '(\\d{6})', 1)) AS code, regexp_extract(folder, '\\d{6}([一-龥]+[区县市])', 1) AS name FROM v_layer", LY)
def _(c):
    return c.layer.select("folder").distinct().select("folder", ingest.district_code(F.col("folder")).alias("code"), ingest.district_name(F.col("folder")).alias("name"))


_RASTERS = ["a/DEM.tif", "b/dsm_1.tif", "c/Dom.tif", "device/x.tif", "wind/z.tif", "LandUse/1.tif", "地形/1.tif", "数字表面/2.tif", "风区/3.tif", "地类/4.tif", "other/5.tif", "高程2/land_use.tif"]


@query("raster_type", "SELECT * FROM (VALUES ('a/DEM.tif', 'DEM'), ('b/dsm_1.tif', 'DEM'), ('c/Dom.tif', 'DOM'), ('device/x.tif', 'WIND_ICE_ZONE'), ('wind/z.tif', 'WIND_ICE_ZONE'), ('LandUse/1.tif', 'LANDUSE'), ('地形/1.tif', 'DEM'), ('数字表面/2.tif', 'DSM'), ('风区/3.tif', 'WIND_ICE_ZONE'), ('地类/4.tif', 'LANDUSE'), ('other/5.tif', 'UNKNOWN_RASTER'), ('高程2/land_use.tif', 'LANDUSE')) AS t(path, kind)")
def _(c):
    return c.spark.createDataFrame([(x,) for x in _RASTERS], "path string").select("path", ingest.raster_type(F.col("path")).alias("kind"))


@query("variant_inventory", f"""WITH {_PARSED}, n AS (SELECT base_level2 AS name, count(*) FILTER (WHERE variant = 'primary') AS "primary", count(*) FILTER (WHERE variant = 'protection') AS protection, count(*) FILTER (WHERE variant = 'reward') AS reward, min(canonical_level2) AS canonical FROM pr GROUP BY 1),
f AS (SELECT canonical_level2 AS name, list_sort(list(DISTINCT base_level2)) AS alias_from FROM pr WHERE base_level2 <> canonical_level2 GROUP BY 1)
SELECT coalesce(n.name, f.name) AS name, coalesce("primary", 0) AS "primary", coalesce(protection, 0) AS protection, coalesce(reward, 0) AS reward, coalesce(canonical, n.name, f.name) AS canonical, array_to_string(coalesce(alias_from, []), ',') AS alias_from FROM n FULL JOIN f ON n.name = f.name""", LY)
def _(c):
    return ingest.variant_inventory(_parsed(c)).withColumn("alias_from", F.array_join("alias_from", ","))


@query("resolution_hist", f"WITH {_PARSED} SELECT k AS resolution_path, (SELECT count(*) FROM pr WHERE pr.resolution_path = k) AS n FROM (VALUES ('rule_table_lookup'), ('feature_dataset_probe'), ('path_inference'), ('unresolved')) AS t(k)", LY)
def _(c):
    keys = ["rule_table_lookup", "feature_dataset_probe", "path_inference", "unresolved"]
    counts = _parsed(c).agg(*[F.count_if(F.col("resolution_path") == k).alias(k) for k in keys])
    return counts.unpivot([], keys, "resolution_path", "n")


@query("protection_coverage", f"WITH {_PARSED} SELECT rule_id, level1, level2, buffer_m FROM rules WHERE buffer_m > 0 AND level2 NOT IN (SELECT base_level2 FROM pr WHERE variant = 'protection' AND fid % 101 = 0 UNION SELECT canonical_level2 FROM pr WHERE variant = 'protection' AND fid % 101 = 0)", LY)
def _(c):
    return ingest.protection_coverage(ingest.variant_inventory(_parsed(c).filter("fid % 101 = 0")), c.rules)


@query("theme_map", "SELECT f.fid, r.level1, r.level2 FROM (SELECT fid, str_split(folder, '/')[-1] AS theme FROM v_layer) f JOIN lookups l ON l.kind = 'theme' AND l.phrase = f.theme JOIN rules r ON CAST(r.rule_id AS VARCHAR) = l.means", LY)
def _(c):
    table = c.spark.createDataFrame([(w, a, b) for _, w, a, b in ingest.phrase_rows("theme")], "theme string, level1 string, level2 string")
    return c.layer.select("fid", F.element_at(F.split("folder", "/"), -1).alias("theme")).join(F.broadcast(table), "theme").select("fid", "level1", "level2")


_RAW = "CASE fid % 4 WHEN 0 THEN b WHEN 1 THEN '  ' || b || ' ' WHEN 2 THEN replace(replace(b, 'kV', ' kV '), '（', '(') ELSE b || '网' END"


def _raw(c):
    b = ingest.layer_base(F.col("layer"))
    raw = F.when(F.col("fid") % 4 == 0, b).when(F.col("fid") % 4 == 1, F.concat(F.lit("  "), b, F.lit(" "))).when(F.col("fid") % 4 == 2, F.replace(F.replace(b, F.lit("kV"), F.lit(" kV ")), F.lit("（"), F.lit("("))).otherwise(F.concat(b, F.lit("网")))
    return c.layer.select("fid", raw.alias("raw"))


@query("normalize_text", f"WITH b AS (SELECT fid, regexp_extract(layer, {_RE}, 1) AS b FROM v_layer) SELECT fid, regexp_replace(replace(replace(replace(lower(trim({_RAW})), '（', '('), '）', ')'), '－', '-'), '[ \\t]', '', 'g') AS norm FROM b", LY)
def _(c):
    return _raw(c).select("fid", classify.normal_text(F.col("raw")).alias("norm"))


_NORM = "regexp_replace(replace(replace(replace(lower(trim({0})), '（', '('), '）', ')'), '－', '-'), '[ \\t]', '', 'g')"
_TIERS = f"""b AS (SELECT fid, regexp_extract(layer, {_RE}, 1) AS b FROM v_layer), q AS (SELECT DISTINCT {_RAW} AS raw FROM b), nm AS (SELECT position, phrase, r.level1, r.level2 FROM lookups JOIN rules r ON CAST(r.rule_id AS VARCHAR) = means WHERE kind = 'normal'),
v AS (SELECT raw, lower(replace(regexp_extract(raw, '[±]?\\d+\\s*[kK][vV]'), ' ', '')) AS volts FROM q),
t AS (SELECT raw, level1, level2, 1.0 AS score, position FROM v JOIN nm ON phrase = raw UNION ALL SELECT raw, level1, level2, 0.95, position FROM v JOIN nm ON {_NORM.format('phrase')} = {_NORM.format('raw')} UNION ALL SELECT raw, level1, level2, 0.9, position FROM v JOIN nm ON volts <> '' AND contains(lower(replace(phrase, ' ', '')), volts))"""


@query("fuzzy_tiers", f"WITH {_TIERS} SELECT raw, level1, level2, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY score DESC, position) AS k FROM t) z WHERE k = 1", LY)
def _(c):
    """The distinct names are written first: else Spark moves the filter below distinct() and matches every row."""
    return table(_raw(c).select("raw").distinct(), "names").withColumn("m", classify.sure_match(F.col("raw"))).filter("m IS NOT NULL").select("raw", "m.*")


@query("fuzzy_ratio")
def _(c):
    return classify.match_names(_raw(c).select("raw").distinct(), "raw", "m").select("raw", "m.*")


@query("assign_rule_id", f"WITH {_PARSED} SELECT fid, coalesce(a.rule_id, b.rule_id, -1) AS std_rule_id FROM pr LEFT JOIN rules a ON a.level2 = base_level2 LEFT JOIN rules b ON b.level2 = canonical_level2", LY)
def _(c):
    return _parsed(c).select("fid", classify.assign_rule(F.col("base_level2"), F.col("canonical_level2")).alias("std_rule_id"))


def _features(c):
    fields = F.create_map(F.lit("level2"), F.lit("  "), F.lit("name"), F.when(F.col("fid") % 2 == 0, F.lit("国道")), F.lit("LV1_CLASS"), F.lit("交通敏感点 "), F.lit("type"), F.lit("河流"))
    return _parsed(c).withColumn("attrs", fields).select("fid", "layer", F.col("level1").alias("path_level1"), F.col("base_level2").alias("path_level2"), F.col("canonical_level2").alias("path_canonical"), F.element_at(F.split("folder", "/"), -1).alias("theme"), classify.discover(F.col("attrs"), classify.LEVEL1_FIELDS).alias("raw_level1"), classify.discover(F.col("attrs"), classify.LEVEL2_FIELDS).alias("raw_level2"))


@query("discover_fields", "SELECT fid, '交通敏感点' AS raw_level1, CASE WHEN fid % 2 = 0 THEN '国道' ELSE '河流' END AS raw_level2 FROM v_layer", LY)
def _(c):
    return _features(c).select("fid", "raw_level1", "raw_level2")


#: Names with the class and score that the published matching rules give them, and whether the name as a layer is scored alike.
_GOLDEN = [("省道", "省道", "1e0", "true"), ("自然保护区 核心区", "自然保护区核心区", "95e-2", "false"), ("35 kV 架空线", "35kV输电线路", "9e-1", "false"), ("±500 kV直流", "±500kV输电线路", "9e-1", "false"), ("10kV线路", "110kV输电线路", "9e-1", "false"), ("高速公路网", "高速公路", "8e0 / 9", "true"), ("通航河道", "通航河流", "75e-2", "true"), ("变电所", "变电站", "2e0 / 3", "true"), ("水库", "炸药库", "4e-1", "true")]
_CASES = f"""g AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}', '{b}', CAST({x} AS DOUBLE), {alike})" for i, (n, b, x, alike) in enumerate(_GOLDEN))}) AS t(k, name, l2, score, alike)),
f AS (SELECT p_partkey AS fid, p_partkey % 6 AS kind, g.*, r.level1 AS l1 FROM part JOIN g ON g.k = p_partkey % 9 JOIN rules r ON r.level2 = g.l2),
d AS (SELECT *, CASE WHEN kind = 0 OR (kind = 1 AND name = l2) THEN 'path_deterministic' WHEN kind = 1 AND score >= 85e-2 THEN 'path_fuzzy_auto' WHEN kind = 2 THEN 'deterministic_theme' WHEN kind = 3 AND score >= 6e-1 THEN 'path_l1_field_l2_' || CASE WHEN score >= 85e-2 THEN 'auto' ELSE 'review' END WHEN kind IN (1, 3) THEN 'path_l1_only' WHEN kind = 4 AND score >= 6e-1 THEN 'fuzzy_' || CASE WHEN score >= 85e-2 THEN 'auto' ELSE 'review' END WHEN kind = 5 AND alike AND score >= 6e-1 THEN 'layer_name_' || CASE WHEN score >= 85e-2 THEN 'auto' ELSE 'review' END ELSE 'unmapped' END AS how FROM f),
e AS (SELECT fid, how, CASE WHEN how = 'path_deterministic' THEN '路径' WHEN how = 'deterministic_theme' THEN t.level1 WHEN how = 'path_l1_only' THEN '路径' WHEN how = 'unmapped' THEN 'UNKNOWN' ELSE l1 END AS a, CASE WHEN kind = 0 THEN '高速公路' WHEN how = 'deterministic_theme' THEN t.level2 WHEN how IN ('path_l1_only', 'unmapped') THEN 'UNKNOWN' ELSE l2 END AS b, CASE WHEN how IN ('path_deterministic', 'deterministic_theme') THEN 1 WHEN how = 'path_l1_only' THEN 5e-1 WHEN how = 'unmapped' THEN 0 ELSE score END AS s FROM d CROSS JOIN (SELECT r.level1, r.level2 FROM lookups l JOIN rules r ON CAST(r.rule_id AS VARCHAR) = l.means WHERE l.kind = 'theme' AND l.phrase = '永久基本农田') t)"""


def _named(c):
    """Features that need every method: a sure path, a path like a class, a theme, attributes with and without a path, a layer name."""
    name = F.element_at(F.array(*[F.lit(g[0]) for g in _GOLDEN]), (F.col("p_partkey") % 9 + 1).cast("int"))
    kind = F.col("p_partkey") % 6
    at = lambda *which: kind.isin(*which)
    alike = F.element_at(F.array(*[F.lit(g[3] == "true") for g in _GOLDEN]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return c.table("part").select(
        F.col("p_partkey").alias("fid"), F.when(at(0, 1, 3), "路径").alias("path_level1"), F.when(at(0), "高速公路").alias("path_level2"), F.when(at(1), name).alias("path_canonical"), F.when(at(2), "永久基本农田").alias("theme"),
        F.lit(" ").alias("raw_level1"), F.when(at(3, 4), name).alias("raw_level2"), F.when(at(5) & alike, name).alias("layer"),
    )


@query("semantic_map", f"WITH {_CASES} SELECT e.fid, a AS std_level1, b AS std_level2, coalesce(r.rule_id, -1) AS std_rule_id, how AS mapping_method, round(s, 6) AS mapping_confidence FROM e LEFT JOIN rules r ON r.level2 = e.b", ("rules", "lookups"))
def _(c):
    """All eleven methods occur."""
    return classify.classify(_named(c)).select("fid", "std_level1", "std_level2", "std_rule_id", "mapping_method", F.round("mapping_confidence", 6).alias("mapping_confidence"))


@query("semantic_layers", f"WITH {_PARSED} SELECT pr.fid, pr.level1 AS std_level1, pr.base_level2 AS std_level2, r.rule_id AS std_rule_id, 'path_deterministic' AS mapping_method, CAST(1 AS DOUBLE) AS mapping_confidence FROM pr JOIN rules r ON r.level2 = canonical_level2 UNION ALL SELECT pr.fid, r.level1, r.level2, r.rule_id, 'deterministic_theme', 1.0 FROM pr JOIN lookups l ON l.kind = 'theme' AND l.phrase = str_split(pr.folder, '/')[-1] JOIN rules r ON CAST(r.rule_id AS VARCHAR) = l.means WHERE pr.canonical_level2 NOT IN (SELECT level2 FROM rules)", LY)
def _(c):
    return classify.classify(_features(c)).filter("mapping_method IN ('path_deterministic', 'deterministic_theme')").select("fid", "std_level1", "std_level2", "std_rule_id", "mapping_method", "mapping_confidence")


_METHODS = ["deterministic", "fuzzy_auto", "fuzzy_review", "unmapped"]


@query("mapping_stats", "WITH n AS (SELECT count(*) AS n FROM v_layer) SELECT 'deterministic' AS kind, n - (SELECT count(*) FROM v_layer WHERE layer LIKE '无名图层%' AND str_split(folder, '/')[-1] NOT IN ('永久基本农田', '城镇开发边界')) AS n FROM n UNION ALL SELECT 'fuzzy_auto', (SELECT count(*) FROM v_layer WHERE layer LIKE '无名图层%' AND str_split(folder, '/')[-1] NOT IN ('永久基本农田', '城镇开发边界')) UNION ALL SELECT 'fuzzy_review', 0 UNION ALL SELECT 'unmapped', 0", LY)
def _(c):
    how = F.col("mapping_method")
    kind = F.when(how.isin("path_deterministic", "path_fuzzy_auto", "deterministic_theme"), "deterministic").when(how.like("%auto"), "fuzzy_auto").when(how == "unmapped", "unmapped").otherwise("fuzzy_review")
    counts = classify.classify(_features(c)).select(kind.alias("kind")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in _METHODS])
    return counts.unpivot([], _METHODS, "kind", "n")


@query("diversity", f"WITH {_PARSED} SELECT level1, count(*) AS n, (SELECT count(DISTINCT level1) FROM pr WHERE level1 <> '') AS level1_count, (SELECT count(DISTINCT base_level2) FROM pr WHERE level1 <> '') AS level2_count, (SELECT count(DISTINCT level1) FROM pr WHERE level1 <> '') < 3 OR NOT (SELECT bool_or(level1 = '交通敏感点') AND bool_or(level1 = '电力设施敏感点') FROM pr) AS warned FROM pr WHERE level1 <> '' GROUP BY level1", LY)
def _(c):
    return diversity(_parsed(c).select(F.col("level1"), F.col("base_level2").alias("level2")))


def diversity(mapped):
    """Counts by level1 beside the totals and whether the mix of sources is too thin."""
    known = mapped.filter("level1 <> '' AND level1 <> 'UNKNOWN'")
    totals = known.agg(F.countDistinct("level1").alias("level1_count"), F.countDistinct(F.when(~F.col("level2").isin("", "UNKNOWN"), F.col("level2"))).alias("level2_count"), F.size(F.array_except(F.array(F.lit("交通敏感点"), F.lit("电力设施敏感点")), F.collect_set("level1"))).alias("_m"))
    totals = totals.select("level1_count", "level2_count", ((F.col("level1_count") < 3) | (F.col("_m") > 0)).alias("warned"))
    return known.groupBy("level1").agg(F.count("*").alias("n")).crossJoin(F.broadcast(totals))


@query("dedup_preview", "SELECT min(fid) AS fid, layer FROM v_layer WHERE fid % 3 = 0 GROUP BY layer, fid % 2", LY)
def _(c):
    open_ = _features(c).filter("fid % 3 = 0").withColumn("mapping_method", F.lit("unmapped"))
    return classify.review_candidates(open_).select("fid", "layer")
