"""Queries over lines, angles and projected zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import crs, geometry
from terraloom.operators import lines
from terraloom.plans.registry import query

L = ("line",)
RL = ("rules", "line")
_BASE = "CASE WHEN cost_type = 'forbidden' THEN 999999.0 WHEN base IS NOT NULL THEN base ELSE coalesce(cross_num, 0.0) END"
_AZ = "((degrees(atan2({0}, {1})) + 360) % 360)"
_CUT = """g AS (SELECT *, sqrt(dx1 * dx1 + dy1 * dy1) AS a, sqrt(dx2 * dx2 + dy2 * dy2) AS b FROM v_line), k AS (SELECT *, unnest(range(0, CAST(ceil((a + b) / 50) AS BIGINT))) AS k FROM g), e AS (SELECT *, k * 50e0 AS s, least((k + 1) * 50e0, a + b) AS t FROM k),
p AS (SELECT fid, rule_id, k, CASE WHEN s <= a THEN x1 + dx1 * s / a ELSE x1 + dx1 + dx2 * (s - a) / b END AS px, CASE WHEN s <= a THEN y1 + dy1 * s / a ELSE y1 + dy1 + dy2 * (s - a) / b END AS py, CASE WHEN t <= a THEN x1 + dx1 * t / a ELSE x1 + dx1 + dx2 * (t - a) / b END AS qx, CASE WHEN t <= a THEN y1 + dy1 * t / a ELSE y1 + dy1 + dy2 * (t - a) / b END AS qy FROM e),
sg AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY k) - 1 AS i FROM p WHERE (qx - px) * (qx - px) + (qy - py) * (qy - py) >= 1e-4)"""


def coords(c):
    """The fixture's lines as arrays of points."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("x1"), F.col("y1")
    return c.line.select("fid", "rule_id", F.array(at(x, y), at(x + F.col("dx1"), y + F.col("dy1")), at(x + F.col("dx1") + F.col("dx2"), y + F.col("dy1") + F.col("dy2"))).alias("coords"))


@query("azimuth", f"SELECT fid, round({_AZ.format('dx1', 'dy1')}, 4) AS az1, round({_AZ.format('-dx2', '-dy2')}, 4) AS az2 FROM v_line", L)
def _(c):
    z = F.lit(0.0)
    return c.line.select("fid", F.round(geometry.azimuth(z, z, F.col("dx1"), F.col("dy1")), 4).alias("az1"), F.round(geometry.azimuth(z, z, -F.col("dx2"), -F.col("dy2")), 4).alias("az2"))


@query("crossing_angle", "SELECT a, b, least(abs(a - b) % 180, 180 - abs(a - b) % 180) AS angle FROM (SELECT fid % 360e0 AS a, fid * 7 % 360e0 AS b FROM v_line) t", L)
def _(c):
    return _angles(c).select("a", "b", geometry.crossing_angle(F.col("a"), F.col("b")).alias("angle"))


@query("angle_diff", "SELECT a, b, CASE WHEN abs(a - b) % 360 > 180 THEN 360 - abs(a - b) % 360 ELSE abs(a - b) % 360 END AS angle FROM (SELECT fid % 360e0 AS a, fid * 7 % 360e0 AS b FROM v_line) t", L)
def _(c):
    return _angles(c).select("a", "b", geometry.angle_difference(F.col("a"), F.col("b")).alias("angle"))


def _angles(c):
    return c.line.select((F.col("fid") % 360).cast("double").alias("a"), (F.col("fid") * 7 % 360).cast("double").alias("b"))


@query("cum_length", "SELECT fid, 0 AS i, 0e0 AS along FROM v_line UNION ALL SELECT fid, 1, round(sqrt(dx1 * dx1 + dy1 * dy1), 4) FROM v_line UNION ALL SELECT fid, 2, round(sqrt(dx1 * dx1 + dy1 * dy1) + sqrt(dx2 * dx2 + dy2 * dy2), 4) FROM v_line", L)
def _(c):
    return lines.cumulative(lines.vertices(coords(c))).select("fid", "i", F.round("along", 4).alias("along"))


@query("interpolate_at", "SELECT fid, d, round(CASE WHEN d <= a THEN x1 + dx1 * d / a WHEN d >= a + b THEN x1 + dx1 + dx2 ELSE x1 + dx1 + dx2 * (d - a) / b END, 4) AS x, round(CASE WHEN d <= a THEN y1 + dy1 * d / a WHEN d >= a + b THEN y1 + dy1 + dy2 ELSE y1 + dy1 + dy2 * (d - a) / b END, 4) AS y FROM (SELECT *, sqrt(dx1 * dx1 + dy1 * dy1) AS a, sqrt(dx2 * dx2 + dy2 * dy2) AS b FROM v_line) g CROSS JOIN (SELECT * FROM (VALUES (0e0), (17e0), (120e0), (1000e0)) AS q(d)) q", L)
def _(c):
    asked = c.spark.createDataFrame([(0.0,), (17.0,), (120.0,), (1000.0,)], "d double")
    at = coords(c).withColumn("p", lines.with_lengths(F.col("coords"))).crossJoin(F.broadcast(asked)).withColumn("q", lines.at_distance(F.col("p"), F.col("d")))
    return at.select("fid", "d", F.round("q.x", 4).alias("x"), F.round("q.y", 4).alias("y"))


@query("segment_lines", f"WITH {_CUT} SELECT fid, i, round(px, 4) AS x1, round(py, 4) AS y1, round(qx, 4) AS x2, round(qy, 4) AS y2, round({_AZ.format('qx - px', 'qy - py')}, 2) AS azimuth_deg FROM sg", L)
def _(c):
    return lines.segment(coords(c)).select("fid", "i", *[F.round(x, 4).alias(x) for x in ("x1", "y1", "x2", "y2")], F.round("azimuth_deg", 2).alias("azimuth_deg"))


@query("linear_cross", f"WITH {_CUT} SELECT 'seg_' || fid || '_0_' || i AS segment_id, 'feat_' || fid AS parent_feature_id, r.rule_id, r.level2, r.min_angle AS min_cross_angle_deg, CAST({_BASE} AS DOUBLE) AS cross_cost, r.cost_type, r.buffer_m AS buffer_dist_m FROM sg JOIN rules r ON r.rule_id = sg.rule_id WHERE min_angle IS NOT NULL OR {_BASE} > 0", RL)
def _(c):
    return lines.linear_cross(coords(c), c.rules).select("segment_id", "parent_feature_id", "rule_id", "level2", F.col("min_angle").alias("min_cross_angle_deg"), F.col("base_cost").alias("cross_cost"), "cost_type", F.col("buffer_m").alias("buffer_dist_m"))


@query("crossing_windows", f"WITH {_CUT} SELECT 'seg_' || fid || '_0_' || i AS segment_id, r.rule_id, round((px + qx) / 2, 4) AS x, round((py + qy) / 2, 4) AS y FROM sg JOIN rules r ON r.rule_id = sg.rule_id WHERE min_angle IS NOT NULL OR {_BASE} > 0", RL)
def _(c):
    return lines.crossing_windows(lines.linear_cross(coords(c), c.rules)).select("segment_id", "rule_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_NAMES = "CASE fid % 5 WHEN 0 THEN '长江支流' WHEN 1 THEN '小溪' WHEN 2 THEN '黄河' WHEN 3 THEN NULL ELSE '' END"


def _rivers(c):
    name = F.when(F.col("fid") % 5 == 0, "长江支流").when(F.col("fid") % 5 == 1, "小溪").when(F.col("fid") % 5 == 2, "黄河").when(F.col("fid") % 5 == 4, "")
    return coords(c).filter("rule_id IN (61, 62)").withColumn("name", name)


def wide_by_name(rivers, keywords):
    """(barriers, others): rivers whose name holds a keyword, and the rest. Keywords are few, given by configuration."""
    keys = F.broadcast(keywords)
    hit = F.coalesce(F.col("name"), F.lit("")).contains(F.col("keyword"))
    return rivers.join(keys, hit, "left_semi"), rivers.join(keys, hit, "left_anti")


@query("wide_name_rivers", f"SELECT fid, CASE WHEN n LIKE '%长江%' OR n LIKE '%黄河%' THEN 'barrier' ELSE 'segments' END AS kind FROM (SELECT fid, coalesce({_NAMES}, '') AS n FROM v_line WHERE rule_id IN (61, 62)) t", L)
def _(c):
    wide, rest = wide_by_name(_rivers(c), c.spark.createDataFrame([("长江",), ("黄河",)], "keyword string"))
    return wide.select("fid", F.lit("barrier").alias("kind")).unionByName(rest.select("fid", F.lit("segments").alias("kind")))


@query("river_degraded", f"WITH {_CUT} SELECT 'river_seg_' || fid || '_' || i AS segment_id, rule_id, 'river_degraded' AS emitter FROM sg WHERE rule_id IN (61, 62) AND fid % 5 NOT IN (0, 2)", L)
def _(c):
    _, rest = wide_by_name(_rivers(c), c.spark.createDataFrame([("长江",), ("黄河",)], "keyword string"))
    return lines.segment(rest).select(F.concat_ws("_", F.lit("river_seg"), "fid", "i").alias("segment_id"), "rule_id", F.lit("river_degraded").alias("emitter"))


_WALK = "v AS (SELECT o_custkey AS fid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CAST(o_orderkey % 97 AS DOUBLE) AS x, CAST(o_orderkey % 89 AS DOUBLE) AS y FROM orders)"


def _walk(c):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return c.table("orders").select(F.col("o_custkey").alias("fid"), (F.row_number().over(w) - 1).alias("i"), (F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_orderkey") % 89).cast("double").alias("y"))


@query("smooth_line", f"WITH {_WALK}, n AS (SELECT *, count(*) OVER (PARTITION BY fid) - 1 AS m FROM v), h AS (SELECT *, least(2, i, m - i) AS h FROM n) SELECT a.fid, a.i, round(avg(b.x), 4) AS sx, round(avg(b.y), 4) AS sy FROM h a JOIN v b ON b.fid = a.fid AND b.i BETWEEN a.i - a.h AND a.i + a.h GROUP BY a.fid, a.i")
def _(c):
    return lines.smooth(_walk(c)).select("fid", "i", F.round("sx", 4).alias("sx"), F.round("sy", 4).alias("sy"))


@query("tangents", f"WITH {_WALK}, d AS (SELECT fid, i, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM v WINDOW w AS (PARTITION BY fid ORDER BY i)) SELECT fid, i, coalesce(round(dx / nullif(sqrt(dx * dx + dy * dy), 0), 4), 0) AS tx, coalesce(round(dy / nullif(sqrt(dx * dx + dy * dy), 0), 4), 0) AS ty FROM d")
def _(c):
    return lines.tangents(_walk(c)).select("fid", "i", (F.round("tx", 4) + 0.0).alias("tx"), (F.round("ty", 4) + 0.0).alias("ty"))


@query("rolling_median", f"WITH {_WALK} SELECT a.fid, a.i, round(median(b.x), 4) AS median FROM v a JOIN v b ON b.fid = a.fid AND b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY a.fid, a.i")
def _(c):
    return lines.rolling_median(_walk(c), "x", "fid", "i").select("fid", "i", F.round("median", 4).alias("median"))


_STEPS = "d{0} AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, lead(x) OVER w - x AS ex, lead(y) OVER w - y AS ey FROM {1} WINDOW w AS (PARTITION BY fid ORDER BY i)), s{0} AS (SELECT *, dx * dx + dy * dy AS p, ex * ex + ey * ey AS q, sqrt(dx * dx + dy * dy) AS s, coalesce(dx * ex + dy * ey < 0 AND 2 * (dx * ex + dy * ey) * (dx * ex + dy * ey) > (dx * dx + dy * dy) * (ex * ex + ey * ey), false) AS back FROM d{0})"


@query("split_zigzag", f"""WITH {_WALK}, {_STEPS.format(1, 'v')}, m AS (SELECT fid, median(s) AS mid FROM s1 GROUP BY fid),
j AS (SELECT s1.fid, i, x, y, mid, greatest(75, 3 * mid) AS jump, coalesce(back AND abs(dx * (dy + ey) - dy * (dx + ex)) / sqrt(nullif((dx + ex) * (dx + ex) + (dy + ey) * (dy + ey), 0)) < 6e-1 * mid AND greatest(s, sqrt(q)) <= greatest(75, 3 * mid), false) AS jitter FROM s1 JOIN m ON m.fid = s1.fid), kp AS (SELECT fid, i, x, y, jump FROM j WHERE NOT jitter), {_STEPS.format(2, 'kp')},
c AS (SELECT *, coalesce(s > jump, false) OR back OR coalesce(lag(back) OVER (PARTITION BY fid ORDER BY i), false) AS cut FROM s2), g AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY i) AS island FROM c), k AS (SELECT *, count(*) OVER (PARTITION BY fid, island) AS n FROM g) SELECT fid, i, island FROM k WHERE n >= 2""")
def _(c):
    return lines.islands(_walk(c), 30.0).select("fid", "i", "island")


@query("drop_outside_ends", f"WITH {_WALK}, b AS (SELECT fid, min(i) FILTER (WHERE x < 60) AS lo, max(i) FILTER (WHERE x < 60) AS hi FROM v GROUP BY fid) SELECT v.fid, v.i FROM v JOIN b ON b.fid = v.fid AND v.i BETWEEN lo AND hi")
def _(c):
    return lines.drop_outside_ends(_walk(c).withColumn("inside", F.col("x") < 60), "inside").select("fid", "i")


@query("longest_part", "SELECT fid, CASE WHEN a >= b THEN 1 ELSE 2 END AS part, round(greatest(a, b), 4) AS length FROM (SELECT fid, sqrt(dx1 * dx1 + dy1 * dy1) AS a, sqrt(dx2 * dx2 + dy2 * dy2) AS b FROM v_line) t", L)
def _(c):
    parts = c.line.select("fid", F.explode(F.array(F.struct(F.lit(1).alias("part"), F.hypot("dx1", "dy1").alias("len")), F.struct(F.lit(2).alias("part"), F.hypot("dx2", "dy2").alias("len")))).alias("p")).select("fid", "p.*")
    return parts.groupBy("fid").agg(F.max_by("part", F.struct("len", -F.col("part"))).alias("part"), F.round(F.max("len"), 4).alias("length"))


_EPSG = "(SELECT * FROM (VALUES ('EPSG:4547'), ('4490'), (' epsg:4534 '), ('WGS84'), (''), ('EPSG:4501')) AS t(crs))"


def _codes(c):
    return c.spark.createDataFrame([("EPSG:4547",), ("4490",), (" epsg:4534 ",), ("WGS84",), ("",), ("EPSG:4501",)], "crs string")


@query("parse_epsg", f"SELECT crs, try_cast(nullif(regexp_extract(upper(trim(crs)), '^(?:EPSG:)?(\\d+)$', 1), '') AS INT) AS epsg FROM {_EPSG} e")
def _(c):
    return _codes(c).select("crs", crs.parse_epsg(F.col("crs")).alias("epsg"))


_LON = "(SELECT c_custkey AS fid, 70 + (c_custkey * 37 % 7000) / 100e0 AS lo, 70 + (c_custkey * 37 % 7000) / 100e0 + (c_custkey % 9) * 5e-1 AS hi FROM customer)"


def _boxes(c):
    lo = 70 + (F.col("c_custkey") * 37 % 7000) / 100.0
    return c.table("customer").select(F.col("c_custkey").alias("fid"), lo.alias("lo"), (lo + (F.col("c_custkey") % 9) * 0.5).alias("hi"))


_C3 = "least(greatest(CAST(round_even({0} / 3, 0) AS INT) * 3, 75), 135)"
_C6 = "least(greatest(CAST(round_even(({0} - 3) / 6, 0) AS INT) * 6 + 3, 75), 135)"


@query("nearest_cm", f"SELECT fid, {_C3.format('lo')} AS cm3, {_C6.format('lo')} AS cm6 FROM {_LON} t")
def _(c):
    return _boxes(c).select("fid", crs.nearest_3(F.col("lo")).alias("cm3"), crs.nearest_6(F.col("lo")).alias("cm6"))


@query("scale_distortion", "SELECT fid, round(power(radians(abs(lo - 117)) * cos(radians(30)), 2) / 2, 8) AS distortion FROM " + _LON + " t")
def _(c):
    return _boxes(c).select("fid", F.round(crs.distortion(F.lit(117), F.col("lo")), 8).alias("distortion"))


@query("recommend_crs", f"SELECT fid, CASE WHEN hi - lo > 3 THEN 4491 + ({_C6.format('m')} - 75) // 6 ELSE 4534 + ({_C3.format('m')} - 75) // 3 END AS epsg, CASE WHEN hi - lo > 3 THEN {_C6.format('m')} ELSE {_C3.format('m')} END AS meridian FROM (SELECT *, (lo + hi) / 2 AS m FROM {_LON} t) u")
def _(c):
    return _boxes(c).select("fid", crs.recommend(F.col("lo"), F.col("hi")).alias("r")).select("fid", "r.epsg", "r.meridian")


@query("validate_crs", f"SELECT fid, crs, CASE WHEN code IS NULL THEN 'error' WHEN lo IS NULL THEN 'info' WHEN cm IS NULL THEN 'info' WHEN power(radians(abs((lo + hi) / 2 - cm)) * cos(radians(30)), 2) / 2 > 5e-4 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT fid, crs, CASE WHEN fid % 10 > 0 THEN lo END AS lo, hi, try_cast(nullif(regexp_extract(upper(trim(crs)), '^(?:EPSG:)?(\\d+)$', 1), '') AS INT) AS code, CASE trim(upper(crs)) WHEN 'EPSG:4547' THEN 114 WHEN 'EPSG:4534' THEN 75 WHEN 'EPSG:4501' THEN 135 END AS cm FROM {_LON} t CROSS JOIN {_EPSG} e) u")
def _(c):
    lo = F.when(F.col("fid") % 10 > 0, F.col("lo"))
    return _boxes(c).crossJoin(F.broadcast(_codes(c))).select("fid", "crs", crs.validate(F.col("crs"), lo, F.col("hi")).alias("status"))


@query("projection_round_trip")
def _(c):
    from pyspark.sql.functions import lit

    at = _boxes(c).filter("lo > 75 AND lo < 135").select("fid", F.col("lo").alias("lon"), (20 + F.col("fid") % 300 / 10.0).alias("lat"), crs.nearest_3(F.col("lo")).cast("double").alias("cm"))
    there = at.withColumn("p", crs.to_plane("lon", "lat", "cm")).withColumn("q", crs.to_lonlat("p.x", "p.y", "cm"))
    return there.select("fid", "lon", "lat", "p.x", "p.y", (F.abs(F.col("q.lon") - F.col("lon")) + F.abs(F.col("q.lat") - F.col("lat")) < lit(1e-8)).alias("ok"))


@query("bounds_reproject")
def _(c):
    """Bounds in the plane of boxes in degrees, from 21 samples on each edge."""
    box = _boxes(c).filter("lo > 76 AND hi < 134 AND hi > lo").select("fid", "lo", "hi", F.lit(23.0).alias("la"), F.lit(24.5).alias("lb"), crs.nearest_3((F.col("lo") + F.col("hi")) / 2).cast("double").alias("cm"))
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: i / 20.0))
    on = box.withColumn("t", t).withColumn("x", F.col("lo") + F.col("t") * (F.col("hi") - F.col("lo"))).withColumn("y", F.col("la") + F.col("t") * (F.col("lb") - F.col("la")))
    edge = on.select("fid", "cm", F.explode(F.array(*[F.struct(F.col(a).cast("double").alias("lon"), F.nullif(F.col(b), F.lit(-99.0)).alias("lat")) for a, b in (("x", "la"), ("x", "lb"), ("lo", "y"), ("hi", "y"))])).alias("e"))
    at = edge.withColumn("p", crs.to_plane("e.lon", "e.lat", "cm"))
    return at.groupBy("fid").agg(F.min("p.x").alias("xmin"), F.min("p.y").alias("ymin"), F.max("p.x").alias("xmax"), F.max("p.y").alias("ymax"))
