"""Queries over the navigation graph, parallel runs, workspace and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import gates, graph, lines, parallel, spatial
from terraloom.operators import grid as G
from terraloom.plans.queries_spatial import clip_box
from terraloom.plans.registry import query
from terraloom.storage import table

V, PT, L = ("grid",), ("point",), ("line",)
RES, TOP = 100.0, 12500.0


def cells(c):
    """The elevation grid as costs: holes are forbidden."""
    bad = F.col("elev").isNull()
    g = c.grid.select("r", "c", bad.alias("forbidden"), F.when(bad, 999999.0).otherwise(F.col("zone_code") + 1.0).alias("lpcf"))
    return G.distance_to(g, "forbidden").withColumn("distance_m", F.col("distance") * RES)


def blocks(c):
    return G.blocks(cells(c), 5)


_CELL = "ce AS (SELECT r, c, elev IS NULL AS bad, CASE WHEN elev IS NULL THEN 999999 ELSE zone_code + 1 END AS lp FROM v_grid), ed AS (SELECT a.r, a.c, a.bad, a.lp, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d2 FROM ce a LEFT JOIN ce b ON b.bad GROUP BY a.r, a.c, a.bad, a.lp)"
_BLOCK = f"{_CELL}, bl AS (SELECT r // 5 AS br, c // 5 AS bc, avg(CASE WHEN bad THEN 1e0 ELSE 0 END) AS fr, avg(CASE WHEN lp > 4 AND NOT bad THEN 1e0 ELSE 0 END) AS hcr, min(sqrt(d2)) * 100 AS md FROM ed GROUP BY 1, 2), bk AS (SELECT *, CASE WHEN (fr > 15e-2 AND coalesce(md, 1e9) < 100) OR hcr > 5e-1 THEN 'dense' WHEN coalesce(md, 1e9) < 300 OR hcr > 2e-1 THEN 'complex' ELSE 'open' END AS kind FROM bl)"


@query("block_stats", f"WITH {_BLOCK} SELECT br, bc, round(fr, 6) AS fr, round(hcr, 6) AS hcr, round(md, 4) AS md, kind FROM bk", V)
def _(c):
    return blocks(c).select("br", "bc", F.round("fr", 6).alias("fr"), F.round("hcr", 6).alias("hcr"), F.round("md", 4).alias("md"), "kind")


@query("block_quantiles", f"WITH {_BLOCK} SELECT q, round(CASE q WHEN 10 THEN quantile_cont(hcr, 0.1) WHEN 50 THEN quantile_cont(hcr, 0.5) WHEN 90 THEN quantile_cont(hcr, 0.9) ELSE quantile_cont(hcr, 0.99) END, 6) AS v FROM bk CROSS JOIN (SELECT * FROM (VALUES (10), (50), (90), (99)) AS t(q)) t GROUP BY q", V)
def _(c):
    p = blocks(c).agg(F.percentile("hcr", F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9, 0.99)])).alias("p"))
    return p.select(F.posexplode("p").alias("i", "v")).select(F.element_at(F.array(*[F.lit(x) for x in (10, 50, 90, 99)]), F.col("i") + 1).alias("q"), F.round("v", 6).alias("v"))


@query("threshold_search", f"WITH {_BLOCK}, t AS (SELECT f, m, row_number() OVER (ORDER BY f, m) AS k FROM (SELECT * FROM (VALUES (1e-2), (2e-2), (3e-2), (4e-2), (5e-2)) AS a(f)) a CROSS JOIN (SELECT * FROM (VALUES (50e0), (75e0), (100e0), (150e0), (200e0)) AS b(m)) b), s AS (SELECT f, m, k, avg(CASE WHEN (fr > f AND coalesce(md, 1e9) < m) OR hcr > 5e-1 THEN 1e0 ELSE 0 END) AS share FROM bk CROSS JOIN t GROUP BY f, m, k) SELECT f AS t_fr, m AS t_md, round(share, 6) AS share FROM s ORDER BY round(abs(share - 1e-1), 9), k LIMIT 1", V)
def _(c):
    return search_thresholds(blocks(c), [0.01, 0.02, 0.03, 0.04, 0.05], [50.0, 75.0, 100.0, 150.0, 200.0])


def search_thresholds(b, shares, distances, target: float = 0.1):
    """The pair of thresholds whose share of dense blocks is closest to the target, the first of equals."""
    grid = b.sparkSession.createDataFrame([(i, f, m) for i, (f, m) in enumerate((f, m) for f in shares for m in distances)], "k int, f double, m double")
    dense = ((F.col("fr") > F.col("f")) & (F.coalesce("md", F.lit(1e9)) < F.col("m"))) | (F.col("hcr") > 0.5)
    s = b.crossJoin(F.broadcast(grid)).groupBy("k", "f", "m").agg(F.avg(dense.cast("double")).alias("s"))
    return s.agg(F.min_by(F.struct("f", "m", "s"), F.struct(F.round(F.abs(F.col("s") - target), 9), "k")).alias("b")).select(F.col("b.f").alias("t_fr"), F.col("b.m").alias("t_md"), F.round("b.s", 6).alias("share"))


@query("node_budget", "SELECT CAST(ceil(area * 60 * 13e-1) AS BIGINT) AS nodes FROM (SELECT CASE WHEN count(elev) * 1e0 / count(*) > 1e-1 THEN count(elev) * 1e-2 ELSE count(*) * 1e-2 END AS area FROM v_grid) t", V)
def _(c):
    area = F.when(F.count("elev") / F.count("*") > 0.1, F.count("elev")).otherwise(F.count("*")) * (RES / 1000) ** 2
    return c.grid.agg(F.ceil(F.round(area * 60 * 1.3, 6)).alias("nodes"))


_PICK = f"{_BLOCK}, sp AS (SELECT *, CASE kind WHEN 'dense' THEN 1 WHEN 'complex' THEN 2 ELSE 4 END AS st, CASE kind WHEN 'dense' THEN 12 WHEN 'complex' THEN 9 ELSE 2 END AS cap FROM bk), cn AS (SELECT e.r, e.c, e.bad, e.lp, br, bc, cap, row_number() OVER (PARTITION BY br, bc ORDER BY r, c) - 1 AS k, count(*) OVER (PARTITION BY br, bc) AS n FROM ed e JOIN sp ON br = r // 5 AND bc = c // 5 WHERE (r % 5 - st // 2) >= 0 AND (r % 5 - st // 2) % st = 0 AND (c % 5 - st // 2) >= 0 AND (c % 5 - st // 2) % st = 0), pk AS (SELECT *, CASE WHEN n > cap THEN CAST(ceil(n * 1e0 / cap) AS BIGINT) ELSE 1 END AS sd FROM cn), sa AS (SELECT * FROM pk WHERE k % sd = 0 AND k / sd < cap), nd AS (SELECT row_number() OVER (ORDER BY br, bc, r, c) - 1 AS fid, (c + 5e-1) * 100 AS x, 12500 - (r + 5e-1) * 100 AS y, lp FROM sa WHERE NOT bad)"


@query("block_sample", f"WITH {_PICK} SELECT r, c FROM sa", V)
def _(c):
    joined = cells(c).withColumns({"br": (F.col("r") / 5).cast("int"), "bc": (F.col("c") / 5).cast("int")}).join(blocks(c).select("br", "bc", "kind"), ["br", "bc"])
    return graph.sample_blocks(joined, 5, RES).select("r", "c")


def nodes(c):
    return graph.skeleton(cells(c), blocks(c), 5, RES, TOP)


@query("skeleton_nodes", f"WITH {_PICK} SELECT fid, x, y, lp * 1e0 AS lpcf FROM nd", V)
def _(c):
    return nodes(c).select("fid", "x", "y", "lpcf")


_EDGE = f"{_PICK}, pr AS (SELECT a.fid AS a, b.fid AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM nd a JOIN nd b ON a.fid < b.fid AND abs(a.x - b.x) <= 350 AND abs(a.y - b.y) <= 350 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 122500), n2 AS (SELECT *, greatest(2, CAST(floor(d / 100) AS BIGINT)) AS n FROM pr), ss AS (SELECT *, unnest(range(0, n + 1)) AS i FROM n2), sc AS (SELECT a, b, d, CAST(floor((ax + i * 1e0 / n * (bx - ax)) / 100) AS INT) AS c, CAST(floor((12500 - (ay + i * 1e0 / n * (by_ - ay))) / 100) AS INT) AS r FROM ss), eg AS (SELECT a, b, d, bool_or(ce.bad) AS f, coalesce(avg(ce.lp) FILTER (WHERE ce.lp < 999999), 1) AS v FROM sc JOIN ce ON ce.r = sc.r AND ce.c = sc.c GROUP BY a, b, d)"


def _pairs(c):
    return graph.candidate_edges(nodes(c), 350.0)


@query("edge_forbidden_anti", f"WITH {_EDGE} SELECT a, b FROM eg WHERE NOT f", V)
def _(c):
    return graph.check_edges(_pairs(c), cells(c), RES, TOP).select("a", "b")


@query("edge_avg_cost", f"WITH {_EDGE} SELECT a, b, round(v, 4) AS avg_lpcf FROM eg WHERE NOT f", V)
def _(c):
    return graph.check_edges(_pairs(c), cells(c), RES, TOP).select("a", "b", F.round("avg_lpcf", 4).alias("avg_lpcf"))


_CONTROL = "cd AS (SELECT row_number() OVER (ORDER BY node_type, seq, x, y) - 1 AS k, x, y FROM (SELECT CASE WHEN ctrl_kind = 'start_end' THEN 'start_end_' || type ELSE ctrl_kind END AS node_type, seq, x, y FROM v_ctrl) t)"
_ALL = f"{_PICK}, {_CONTROL}, al AS (SELECT fid, x, y FROM nd UNION ALL SELECT (SELECT max(fid) FROM nd) + 1 + k, x, y FROM cd), nn AS (SELECT a.fid, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM al a JOIN al b ON a.fid <> b.fid GROUP BY a.fid), ct AS (SELECT least(greatest(4 * median(sqrt(d2)), 500), 1500) AS m FROM nn)"
_NAV = _EDGE.replace(_PICK, _ALL).replace("FROM nd a JOIN nd b ON a.fid < b.fid AND abs(a.x - b.x) <= 350 AND abs(a.y - b.y) <= 350 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 122500", "FROM al a JOIN al b ON a.fid < b.fid CROSS JOIN ct WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= m * m").replace("FROM sc JOIN ce ON", "FROM sc LEFT JOIN ce ON").replace("bool_or(ce.bad)", "coalesce(bool_or(ce.bad), false)")


@query("skeleton_edges", f"WITH {_NAV} SELECT a, b, round(d, 1) AS distance_m, round(v, 4) AS avg_lpcf, round(d * greatest(v, 1e-1), 4) AS edge_cost FROM eg WHERE NOT f AND d >= 1", ("grid", "ctrl"))
def _(c):
    """Control nodes included, the cutoff from the nodes themselves."""
    _, pairs = graph.navigation(nodes(c), graph.control_nodes(c.ctrl))
    return graph.check_edges(pairs, cells(c), RES, TOP).select("a", "b", F.round("d", 1).alias("distance_m"), F.round("avg_lpcf", 4).alias("avg_lpcf"), F.round("edge_cost", 4).alias("edge_cost"))


@query("connected_components", "WITH RECURSIVE e AS (SELECT a.fid AS a, b.fid AS b FROM v_point a JOIN v_point b ON a.fid <> b.fid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 90000), w AS (SELECT a AS v, a AS u FROM e UNION SELECT w.v, e.b FROM w JOIN e ON e.a = w.u) SELECT v, min(u) AS c FROM w GROUP BY v", PT)
def _(c):
    return spatial.linked(c.point, 300.0)


@query("start_end_connected", "WITH RECURSIVE e AS (SELECT a.fid AS a, b.fid AS b FROM v_point a JOIN v_point b ON a.fid <> b.fid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 90000), w AS (SELECT a AS v, a AS u FROM e UNION SELECT w.v, e.b FROM w JOIN e ON e.a = w.u), l AS (SELECT v, min(u) AS c FROM w GROUP BY v), n AS (SELECT c, count(*) AS n FROM l GROUP BY c), p AS (SELECT min(v) AS a, max(v) AS b FROM l) SELECT (SELECT count(*) FROM n) AS components, (SELECT max(n) FROM n) AS largest, (SELECT c FROM l JOIN p ON v = p.a) = (SELECT c FROM l JOIN p ON v = p.b) AS together", PT)
def _(c):
    return graph.connectivity(table(spatial.linked(c.point, 300.0), "linked"))


@query("control_nodes", "SELECT CASE WHEN ctrl_kind = 'start_end' THEN 'start_end_' || type ELSE ctrl_kind END AS node_type, seq, x, y FROM v_ctrl UNION ALL SELECT 'must_path_sample', k, 1000 + k * 2e2, 500e0 FROM (SELECT unnest(range(0, 6)) AS k) t", ("ctrl",))
def _(c):
    points = graph.control_nodes(c.ctrl)
    path = c.spark.sql("SELECT array(named_struct('x', 1000D, 'y', 500D), named_struct('x', 2050D, 'y', 500D)) AS p").withColumn("p", lines.with_lengths(F.col("p")))
    n = F.floor(F.element_at("p", -1)["along"] / 200.0)
    at = path.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), n))).withColumn("q", lines.at_distance(F.col("p"), F.col("seq") * 200.0))
    return points.unionByName(at.select(F.lit("must_path_sample").alias("node_type"), "seq", F.col("q.x").alias("x"), F.col("q.y").alias("y")))


@query("nav_mode", "SELECT e, m, CASE WHEN NOT e THEN 'skip' ELSE coalesce(m, 'skip') END AS mode FROM (SELECT * FROM (VALUES (true), (false)) AS a(e)) a CROSS JOIN (SELECT * FROM (VALUES ('immediate'), ('deferred'), ('skip'), (NULL)) AS b(m)) b")
def _(c):
    asked = c.spark.createDataFrame([(e, m) for e in (True, False) for m in ("immediate", "deferred", "skip", None)], "e boolean, m string")
    return asked.select("e", "m", gates.nav_mode(F.col("e"), F.col("m")).alias("mode"))


@query("nav_meta", f"WITH {_EDGE} SELECT 'immediate' AS build_mode, 'completed' AS status, (SELECT count(*) FROM nd) AS node_count, (SELECT count(*) FROM eg WHERE NOT f AND d >= 1) AS edge_count", V)
def _(c):
    n, e = nodes(c).agg(F.count("*").alias("node_count")), graph.check_edges(_pairs(c), cells(c), RES, TOP).agg(F.count("*").alias("edge_count"))
    return n.crossJoin(e).select(F.lit("immediate").alias("build_mode"), F.lit("completed").alias("status"), "node_count", "edge_count")


# Parallel runs: a path beside each of some lines, turning away after the first leg.
_AZ = "((degrees(atan2({0}, {1})) + 360) % 360)"
_SD = "sqrt(power(mx - ({0} + greatest(0, least(1, ((mx - ({0})) * {2} + (my - ({1})) * {3}) / ({2} * {2} + {3} * {3}))) * {2}), 2) + power(my - ({1} + greatest(0, least(1, ((mx - ({0})) * {2} + (my - ({1})) * {3}) / ({2} * {2} + {3} * {3}))) * {3}), 2))"
_STAT = f"""g AS (SELECT fid, x1, y1, dx1 * 20 AS ux, dy1 * 20 AS uy, dx2 * 20 AS vx, dy2 * 20 AS vy FROM v_line WHERE fid % 10 = 0), p AS (SELECT *, sqrt(ux * ux + uy * uy) AS a, sqrt(vx * vx + vy * vy) AS b FROM g), k AS (SELECT *, unnest(range(0, CAST(ceil((a + b) / 50) AS BIGINT))) AS k FROM p), se AS (SELECT *, k * 50e0 AS s, least((k + 1) * 50e0, a + b) AS e FROM k),
q AS (SELECT *, (s + e) / 2 AS m FROM se), w AS (SELECT *, x1 + 100 + CASE WHEN m <= a THEN ux * m / a ELSE ux + vy * (m - a) / b END AS mx, y1 + CASE WHEN m <= a THEN uy * m / a ELSE uy + vx * (m - a) / b END AS my, x1 + 100 + CASE WHEN s <= a THEN ux * s / a ELSE ux + vy * (s - a) / b END AS sx, y1 + CASE WHEN s <= a THEN uy * s / a ELSE uy + vx * (s - a) / b END AS sy, x1 + 100 + CASE WHEN e <= a THEN ux * e / a ELSE ux + vy * (e - a) / b END AS ex, y1 + CASE WHEN e <= a THEN uy * e / a ELSE uy + vx * (e - a) / b END AS ey FROM q),
dd AS (SELECT *, {_SD.format('x1', 'y1', 'ux', 'uy')} AS d1, {_SD.format('x1 + ux', 'y1 + uy', 'vx', 'vy')} AS d2 FROM w), st AS (SELECT fid, k, s, e, a + b AS path_m, least(d1, d2) AS d, abs({_AZ.format('ex - sx', 'ey - sy')} - CASE WHEN d1 <= d2 THEN {_AZ.format('ux', 'uy')} ELSE {_AZ.format('vx', 'vy')} END) % 180 AS q FROM dd),
an AS (SELECT *, least(q, 180 - q) AS angle FROM st)"""
_RUNS = "SELECT fid, min(s) AS s0, max(e) AS e0 FROM (SELECT *, k - row_number() OVER (PARTITION BY fid ORDER BY k) AS i FROM an WHERE path_m >= {2} AND d <= {0} AND angle <= {1}) z GROUP BY fid, i HAVING max(e) - min(s) >= {2}"


def _pair_lines(c):
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, (ux, uy, vx, vy) = F.col("x1"), F.col("y1"), (F.col(n) * 20 for n in ("dx1", "dy1", "dx2", "dy2"))
    line = F.array(at(x, y), at(x + ux, y + uy), at(x + ux + vx, y + uy + vy))
    path = F.array(at(x + 100, y), at(x + 100 + ux, y + uy), at(x + 100 + ux + vy, y + uy + vx))
    return c.line.filter("fid % 10 = 0").select("fid", path.alias("path"), line.alias("line"))


@query("parallel_runs", f"WITH {_STAT} SELECT fid, round(s0, 4) AS start_m, round(e0, 4) AS end_m FROM ({_RUNS.format(120, 15, 300)}) r", L)
def _(c):
    return parallel.runs(parallel.stations(_pair_lines(c)), ["fid"], 120.0, 15.0, 300.0).select("fid", F.round("start_m", 4).alias("start_m"), F.round("end_m", 4).alias("end_m"))


@query("forbidden_parallel", f"WITH {_STAT} SELECT fid FROM ({_RUNS.format(600, 15, 500)}) r GROUP BY fid", L)
def _(c):
    return parallel.runs(parallel.stations(_pair_lines(c)), ["fid"], 600.0, 15.0, 500.0).select("fid").distinct()


@query("parallel_reward", f"WITH {_STAT} SELECT fid, round(sum(e0 - s0) / 1000 * 100, 4) AS reward FROM ({_RUNS.format(120, 15, 300)}) r GROUP BY fid", L)
def _(c):
    return parallel.reward(parallel.runs(parallel.stations(_pair_lines(c)), ["fid"], 120.0, 15.0, 300.0), ["fid"], 100.0).select("fid", F.round("reward", 4).alias("reward"))


@query("path_parallel", f"WITH {_STAT} SELECT p.fid, count(r.fid) AS n_runs, coalesce(round(sum(e0 - s0), 1), 0) AS total_m, coalesce(round(max(e0 - s0), 1), 0) AS longest_m FROM p LEFT JOIN ({_RUNS.format(120, 15, 300)}) r ON r.fid = p.fid GROUP BY p.fid", L)
def _(c):
    pairs = _pair_lines(c)
    r = parallel.runs(parallel.stations(pairs), ["fid"], 120.0, 15.0, 300.0).withColumnRenamed("fid", "_f")
    return pairs.select("fid").join(r, F.col("fid") == F.col("_f"), "left").groupBy("fid").agg(F.count("_f").alias("n_runs"), F.coalesce(F.round(F.sum("length_m"), 1), F.lit(0.0)).alias("total_m"), F.coalesce(F.round(F.max("length_m"), 1), F.lit(0.0)).alias("longest_m"))


# Workspace.
C = ("ctrl",)


@query("control_counts", "SELECT ctrl_kind, count(*) AS n FROM v_ctrl GROUP BY ctrl_kind", C)
def _(c):
    return c.ctrl.groupBy("ctrl_kind").agg(F.count("*").alias("n"))


@query("control_objects", "SELECT ctrl_kind, seq, type, x, y, 'file' AS origin FROM v_ctrl WHERE ctrl_kind <> 'start_end' UNION ALL SELECT * FROM (VALUES ('start_end', 1, 'start', 500e0, 600e0, 'config'), ('start_end', 2, 'end', 9500e0, 9600e0, 'config')) AS t(a, b, c, d, e, f)", C)
def _(c):
    config = c.spark.createDataFrame([("start_end", 1, "start", 500.0, 600.0), ("start_end", 2, "end", 9500.0, 9600.0)], "ctrl_kind string, seq int, type string, x double, y double")
    return controls_or_config(c.ctrl.filter("ctrl_kind <> 'start_end'"), config)


def controls_or_config(found, config):
    """Controls that were found; kinds that weren't fall back to the configured points."""
    return found.withColumn("origin", F.lit("file")).unionByName(config.join(found.select("ctrl_kind").distinct(), "ctrl_kind", "left_anti").withColumn("origin", F.lit("config")))


@query("validate_controls", "SELECT * FROM (VALUES ('must_pass', 'ok'), ('must_path', 'missing'), ('start_end', 'ok'), ('accessible_area', 'empty')) AS t(ctrl_kind, status)", C)
def _(c):
    want = c.spark.createDataFrame([("must_pass", True), ("must_path", False), ("start_end", True), ("accessible_area", True)], "ctrl_kind string, found boolean")
    n = c.ctrl.groupBy("ctrl_kind").agg(F.count("*").alias("n"))
    return want.join(n, "ctrl_kind", "left").select("ctrl_kind", F.when(~F.col("found"), "missing").when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("ok").alias("status"))


@query("workspace_points", "SELECT arg_min(x, seq) FILTER (WHERE type IN ('start', '起点')) AS start_x, arg_min(x, seq) FILTER (WHERE type IN ('end', '终点')) AS end_x FROM v_ctrl WHERE ctrl_kind = 'start_end'", C)
def _(c):
    s = c.ctrl.filter("ctrl_kind = 'start_end'")
    one = lambda names, last: F.coalesce(F.min_by(F.when(F.col("type").isin(*names), F.col("x")), F.when(F.col("type").isin(*names), F.col("seq"))), (F.max_by if last else F.min_by)("x", "seq"))
    return s.agg(one(["start", "起点"], False).alias("start_x"), one(["end", "终点"], True).alias("end_x"))


@query("work_bbox", "SELECT least(min(x), 1000) - 5000 AS xmin, least(min(y), 1000) - 5000 AS ymin, max(x) + 5000 AS xmax, max(y) + 5000 AS ymax, 'controls' AS origin FROM v_ctrl WHERE ctrl_kind IN ('start_end', 'must_pass')", ("ctrl", "poly"))
def _(c):
    return work_box(c.ctrl, c.poly)


def work_box(controls, boxes, dem=None):
    """One row: start and end with what must be passed and 5 km around; else the vectors or the DEM and 5 %; else a default."""
    box = ["xmin", "ymin", "xmax", "ymax"]
    pts = controls.filter("ctrl_kind IN ('start_end', 'must_pass', 'must_path')").select(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    found = [(1, "controls", spatial.bounds(pts), {"fixed": 5000.0}), (2, "vectors", spatial.bounds(boxes), {"ratio": 0.05})]
    if dem is not None:
        found.append((3, "dem", spatial.bounds(dem), {"ratio": 0.05}))
    default = controls.sparkSession.createDataFrame([(9, "default", 0.0, 0.0, 50000.0, 50000.0)], "k int, origin string, xmin double, ymin double, xmax double, ymax double")
    for k, name, b, how in found:
        default = default.unionByName(b.filter("xmin IS NOT NULL").withColumns(spatial.expand(**how)).select(F.lit(k).alias("k"), F.lit(name).alias("origin"), *box))
    return default.agg(F.min_by(F.struct("origin", *box), "k").alias("b")).select("b.*")


@query("clipped_work_bbox", "SELECT greatest(min(x) - 5000, 0) AS xmin, greatest(min(y) - 5000, 0) AS ymin, least(max(x) + 5000, 20000) AS xmax, least(max(y) + 5000, 20000) AS ymax FROM v_ctrl WHERE ctrl_kind IN ('start_end', 'must_pass')", C)
def _(c):
    b = work_box(c.ctrl, c.poly)
    inner = b.withColumns({"mx0": F.col("xmin") + 5000, "my0": F.col("ymin") + 5000, "mx1": F.col("xmax") - 5000, "my1": F.col("ymax") - 5000})
    cut = clip_box((0.0, 0.0, 20000.0, 20000.0))
    return inner.select(*[cut[k].alias(k) for k in ("xmin", "ymin", "xmax", "ymax")])


@query("infer_bbox_lonlat", "SELECT round(116 - 16e-3, 6) AS xmin, round(23 - 1e-2, 6) AS ymin, round(11616e-2 + 16e-3, 6) AS xmax, round(231e-1 + 1e-2, 6) AS ymax")
def _(c):
    ends = c.spark.createDataFrame([(116.0, 23.0), (116.16, 23.1)], "lon double, lat double")
    return lonlat_box(ends)


def lonlat_box(ends):
    """Box of the end points in degrees and 10 % around, each side 0.01 degrees at least."""
    b = ends.agg(F.min("lon").alias("a"), F.min("lat").alias("b"), F.max("lon").alias("c"), F.max("lat").alias("d"))
    dx, dy = F.greatest(F.col("c") - F.col("a"), F.lit(0.01)) * 0.1, F.greatest(F.col("d") - F.col("b"), F.lit(0.01)) * 0.1
    return b.select(F.round(F.col("a") - dx, 6).alias("xmin"), F.round(F.col("b") - dy, 6).alias("ymin"), F.round(F.col("c") + dx, 6).alias("xmax"), F.round(F.col("d") + dy, 6).alias("ymax"))


@query("coord_check", "SELECT * FROM (VALUES (1, 'ok'), (2, 'swapped'), (3, 'out_of_range'), (4, 'ok'), (5, 'looks_geographic'), (6, 'too_large')) AS t(k, status)")
def _(c):
    p = c.spark.createDataFrame([(1, True, 116.0, 23.0), (2, True, 23.0, 116.0), (3, True, 200.0, 95.0), (4, False, 400000.0, 2500000.0), (5, False, 116.0, 23.0), (6, False, 2e8, 1.0)], "k int, geographic boolean, x double, y double")
    x, y = F.abs("x"), F.abs("y")
    geo = F.when((x <= 180) & (y <= 90), "ok").when((x <= 90) & (y <= 180), "swapped").otherwise("out_of_range")
    return p.select("k", F.when(F.col("geographic"), geo).when((x < 200) & (y < 200), "looks_geographic").when((x > 1e8) | (y > 1e8), "too_large").otherwise("ok").alias("status"))


# Gates, over cases spelled out by the bits of part keys.
P = ("poly",)
_DEM = "CASE fid % 7 WHEN 0 THEN NULL WHEN 1 THEN 45e0 ELSE 10e0 END"
_CASE = f"k AS (SELECT fid, fid % 2 = 0 AS river_ok, fid % 3 > 0 AS wind_ok, {_DEM} AS res, CASE WHEN fid % 5 = 0 THEN 2e-1 ELSE 1e-2 END AS nd, fid % 11 = 0 AS dsev, fid % 13 > 0 AS bbox_ok, fid % 17 AS n_polygons, CASE fid % 19 WHEN 0 THEN 'severe' WHEN 1 THEN 'degraded' ELSE 'info' END AS runtime, CASE fid % 4 WHEN 0 THEN 'skip' ELSE 'immediate' END AS build_mode, CASE fid % 23 WHEN 0 THEN 'failed' ELSE 'ok' END AS nav_status, fid % 29 AS nodes, fid % 31 AS edges, fid % 6 > 0 AS connected, fid % 8 < 4 AS planar FROM v_poly), q AS (SELECT *, CASE WHEN res IS NULL THEN 'missing' WHEN dsev THEN 'severe' WHEN res > 30 THEN 'coarse' WHEN nd > 5e-2 THEN 'holes' ELSE 'ok' END AS dem FROM k)"


def cases(c):
    f = F.col("fid")
    k = c.poly.select(
        "fid", (f % 2 == 0).alias("river_ok"), (f % 3 > 0).alias("wind_ok"), F.when(f % 7 == 1, 45.0).when(f % 7 > 1, 10.0).alias("res"), F.when(f % 5 == 0, 0.2).otherwise(0.01).alias("nd"), (f % 11 == 0).alias("dsev"), (f % 13 > 0).alias("bbox_ok"), (f % 17).alias("n_polygons"),
        F.when(f % 19 == 0, "severe").when(f % 19 == 1, "degraded").otherwise("info").alias("runtime"), F.when(f % 4 == 0, "skip").otherwise("immediate").alias("build_mode"), F.when(f % 23 == 0, "failed").otherwise("ok").alias("nav_status"),
        (f % 29).alias("nodes"), (f % 31).alias("edges"), (f % 6 > 0).alias("connected"), (f % 8 < 4).alias("planar"),
    )
    return k.withColumn("dem", gates.dem_quality(F.col("res"), F.col("nd"), F.col("dsev")))


@query("dem_quality", f"WITH {_CASE} SELECT fid, dem FROM q", P)
def _(c):
    return cases(c).select("fid", "dem")


_NAV = "build_mode = 'immediate' AND nav_status <> 'failed'"
_SEV = f"dem IN ('missing', 'severe') OR NOT bbox_ok OR n_polygons = 0 OR runtime = 'severe' OR (build_mode = 'immediate' AND nav_status = 'failed') OR ({_NAV} AND (nodes < 10 OR edges = 0 OR NOT connected))"
_PRE = f"NOT river_ok OR NOT wind_ok OR dem IN ('coarse', 'holes') OR runtime = 'degraded' OR ({_NAV} AND nodes >= 10 AND edges > 0 AND connected AND edges < nodes * 5e-1)"


@query("delivery_level", f"WITH {_CASE} SELECT fid, CASE WHEN {_SEV} THEN 'SEVERE_DEGRADED' WHEN {_PRE} THEN 'PRELIMINARY_ROUTE_ONLY' ELSE 'FORMAL_DELIVERY' END AS level FROM q", P)
def _(c):
    return gates.delivery(cases(c)).select("fid", "level")


@query("severity", f"WITH {_CASE} SELECT fid, CASE WHEN (dem = 'missing' AND NOT planar) OR dem = 'severe' OR fid % 9 = 0 THEN 'SEVERE_DEGRADED' WHEN dem = 'missing' OR dem IN ('coarse', 'holes') OR fid % 9 = 1 THEN 'PRELIMINARY_ROUTE_ONLY' ELSE 'FORMAL_DELIVERY' END AS level FROM q", P)
def _(c):
    files = F.when(F.col("fid") % 9 == 0, F.array(F.lit("m3/lpcf_coarse.tif"))).when(F.col("fid") % 9 == 1, F.array(F.lit("m3/workspace.json"))).otherwise(F.array().cast("array<string>"))
    return gates.severity(cases(c).withColumn("missing_files", files)).select("fid", "level")


@query("operational_mode", f"WITH {_CASE} SELECT fid, CASE WHEN dem NOT IN ('missing', 'severe') THEN '3D' WHEN planar THEN '2D_PLANAR' ELSE 'UNAVAILABLE' END AS mode FROM q", P)
def _(c):
    return cases(c).select("fid", gates.operational_mode(F.col("dem"), F.col("planar")).alias("mode"))


@query("degrade_summary", f"WITH {_CASE} SELECT 'RUNTIME(' || runtime || ')' AS code, count(*) AS n FROM q GROUP BY 1", P)
def _(c):
    return cases(c).groupBy(F.concat(F.lit("RUNTIME("), "runtime", F.lit(")")).alias("code")).agg(F.count("*").alias("n"))


@query("required_files", "SELECT e, f, CASE WHEN e AND f THEN 12 WHEN e THEN 8 ELSE 4 END AS n FROM (SELECT * FROM (VALUES (true), (false)) AS a(e)) a CROSS JOIN (SELECT * FROM (VALUES (true), (false)) AS b(f)) b")
def _(c):
    asked = c.spark.createDataFrame([(e, f) for e in (True, False) for f in (True, False)], "e boolean, f boolean")
    return asked.select("e", "f", F.size(gates.required_files(F.col("e"), F.col("f"))).alias("n"))


@query("required_missing", "SELECT * FROM (VALUES ('m3/solver_params.json'), ('m3/delivery_level.json')) AS t(path)")
def _(c):
    want = c.spark.createDataFrame([(x,) for x in gates.CONFIGS], "path string")
    have = c.spark.createDataFrame([("m3/rule_config.json",), ("m3/workspace.json",), ("other.txt",)], "path string")
    return want.join(have, "path", "left_anti")


@query("verify_manifest", "SELECT * FROM (VALUES ('a', 'ok'), ('b', 'existence'), ('c', 'size'), ('d', 'existence'), ('e', 'ok'), ('version 0.5', 'warning'), ('version 0.7', 'mismatch'), ('version 1.6', 'mismatch'), ('version 0.6', 'ok'), ('version x', 'mismatch')) AS t(path, status)")
def _(c):
    m = c.spark.createDataFrame([("a", True, 10), ("b", True, 20), ("c", True, 30), ("d", False, None), ("e", False, None)], "path string, exists boolean, size long")
    f = c.spark.createDataFrame([("a", 10), ("c", 31), ("d", 5)], "path string, size long")
    versions = c.spark.createDataFrame([("0.5",), ("0.7",), ("1.6",), ("0.6",), ("x",)], "v string")
    return gates.verify_files(m, f).select("path", "status").unionByName(versions.select(F.concat(F.lit("version "), "v").alias("path"), gates.version_check("0.6", F.col("v")).alias("status")))


@query("read_required_layer", "SELECT count(*) FILTER (WHERE fid % 10 > 0) AS n, false AS placeholder_only FROM v_poly", P)
def _(c):
    layer = c.poly.withColumn("_placeholder", F.when(F.col("fid") % 10 == 0, True).when(F.col("fid") % 10 == 1, False))
    real = F.count_if(~F.coalesce("_placeholder", F.lit(False)))
    return layer.agg(real.alias("n"), ((F.count("*") > 0) & (real == 0)).alias("placeholder_only"))


@query("geometry_fix_summary", "SELECT count(*) FILTER (WHERE fid % 3 > 0) AS total, count(*) FILTER (WHERE fid % 3 = 2) AS discarded FROM v_poly", P)
def _(c):
    fixes = c.poly.select(F.when(F.col("fid") % 3 == 1, "make_valid").when(F.col("fid") % 3 == 2, "discarded").alias("fix_type"))
    return fixes.filter("fix_type IS NOT NULL").agg(F.count("*").alias("total"), F.count_if(F.col("fix_type") == "discarded").alias("discarded"))


@query("safe_columns", "SELECT fid, CAST(rule_id AS VARCHAR) AS attr_name, '' AS attr_NAME__2, variant AS attr_type FROM v_poly", P)
def _(c):
    raw = c.poly.select("fid", F.col("rule_id").alias("name"), F.lit(None).cast("int").alias("NAME_"), F.col("variant").alias("type"))
    return safe_columns(raw, {"name": "name", "NAME_": "NAME", "type": "type"})


def safe_columns(df, names: dict[str, str], keep: tuple[str, ...] = ("fid", "geom")):
    """Attributes as text under attr_ names; names that differ in case only get a number, null becomes empty."""
    seen: dict[str, int] = {}
    out = [F.col(k) for k in keep if k in df.columns]
    for column, name in names.items():
        n = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        out.append(F.coalesce(F.col(column).cast("string"), F.lit("")).alias(f"attr_{name}" + (f"__{n}" if n > 1 else "")))
    return df.select(*out)


@query("wind_ice_zones", "SELECT fid, CASE fid % 3 WHEN 0 THEN 'wind' WHEN 1 THEN 'ice' ELSE 'unknown' END AS wi_kind FROM v_poly", P)
def _(c):
    layer = F.element_at(F.array(F.lit("风区划分"), F.lit("Ice_zone"), F.lit("其他")), (F.col("fid") % 3 + 1).cast("int"))
    return c.poly.select("fid", wind_ice_kind(layer).alias("wi_kind"))


def wind_ice_kind(layer):
    low = F.lower(layer)
    return F.when(low.contains("wind") | low.contains("风区"), "wind").when(low.contains("ice") | low.contains("冰"), "ice").otherwise("unknown")


@query("river_mode", "SELECT * FROM (VALUES (1, 'degraded'), (2, 'full'), (3, 'skip'), (4, 'degraded')) AS t(k, mode)")
def _(c):
    asked = c.spark.createDataFrame([(1, True, 5, 1), (2, False, 5, 1), (3, False, 0, 2), (4, False, 0, 0)], "k int, disabled boolean, n_primary int, n_protection int")
    return asked.select("k", F.when(F.col("disabled"), "degraded").when(F.col("n_primary") > 0, "full").when(F.col("n_protection") > 0, "skip").otherwise("degraded").alias("mode"))


RP = ("rules", "poly", "line")


@query("corridor_line_join", "SELECT p.fid, count(l.fid) AS n_lines FROM v_poly p LEFT JOIN v_line l ON l.rule_id = p.rule_id WHERE p.variant = 'reward' GROUP BY p.fid", RP)
def _(c):
    n = c.line.groupBy("rule_id").agg(F.count("*").alias("n"))
    return c.poly.filter("variant = 'reward'").join(n, "rule_id", "left").select("fid", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("corridors", "SELECT p.fid, r.rule_id, r.reward AS parallel_reward, CASE WHEN range_m > 0 THEN range_m WHEN reward > 0 THEN 200 ELSE 0 END AS parallel_range_m, coalesce(try_cast(nullif(regexp_extract(level2, '(?i)(\\d+)\\s*kV', 1), '') AS INT), 0) AS voltage_kv, coalesce(try_cast(nullif(regexp_extract(level2, '(?i)(\\d+)\\s*kV', 1), '') AS INT), 0) >= 800 AS excluded FROM v_poly p JOIN rules r ON r.rule_id = p.rule_id WHERE p.variant = 'reward' AND r.reward > 0", RP)
def _(c):
    from terraloom.functions import cost

    j = c.poly.filter("variant = 'reward'").join(F.broadcast(c.rules), "rule_id").filter("reward > 0").withColumn("voltage_kv", cost.voltage_kv(F.col("level2")))
    return j.select("fid", "rule_id", F.col("reward").alias("parallel_reward"), cost.parallel_range().alias("parallel_range_m"), "voltage_kv", (F.col("voltage_kv") >= 800).alias("excluded"))
