"""Queries over channel polygons and files. Kernels have no SQL form where the oracle is missing; tests hold them to properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import channel, polygons, rivers
from terraloom.operators.alike import spread
from terraloom.plans.registry import query

P = ("poly",)


def _rivers(c):
    """Boxes as channels."""
    return c.poly.withColumn("rings", F.array(polygons.ring(("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))))


#: Boxes of at least this length to width are walked from end to end along their middle; of squatter ones SQL knows only that the line is inside.
_LONG = "xmax - xmin >= 2 * (ymax - ymin)"


@query("centerline", f"SELECT fid, CASE WHEN {_LONG} THEN round((ymin + ymax) / 2, 3) END AS y0, CASE WHEN {_LONG} THEN round((ymin + ymax) / 2, 3) END AS y1, CASE WHEN {_LONG} THEN round(ymax - ymin, 3) END AS width, CASE WHEN {_LONG} THEN true END AS whole, true AS inside FROM v_poly", P)
def _(c):
    """Every box is walked. All but the ends of a long one's line keep to the middle, it has the box's width and most of its length."""
    s = channel.stations(_rivers(c), 50.0)
    g = s.groupBy("fid").agg(F.percentile("y", F.lit(0.25)).alias("y0"), F.percentile("y", F.lit(0.75)).alias("y1"), F.percentile("width", F.lit(0.5)).alias("width"), *[f(k).alias(f"{k}{n}") for k in ("x", "y") for n, f in (("_lo", F.min), ("_hi", F.max))])
    g = c.poly.hint("merge").join(g, "fid")
    inside = F.expr("x_lo >= xmin - 1e-6 AND x_hi <= xmax + 1e-6 AND y_lo >= ymin - 1e-6 AND y_hi <= ymax + 1e-6")
    own = {**{k: F.round(k, 3) for k in ("y0", "y1", "width")}, "whole": F.col("x_hi") - F.col("x_lo") >= 0.8 * (F.col("xmax") - F.col("xmin"))}
    return g.select("fid", *[F.when(F.expr(_LONG), v).alias(k) for k, v in own.items()], inside.alias("inside"))


_ROUND = "2500 * (4 - 16 * sin(pi() / 16))"


@query("river_wide", f"SELECT fid, round((xmax - xmin) * (ymax - ymin) - {_ROUND}, 1) AS area FROM v_poly WHERE fid % 5 = 0 AND least(xmax - xmin, ymax - ymin) > 100", P)
def _(c):
    """Opened by a disc of half of 100 m, a box loses its corners, or everything."""
    wide, _ = channel.analysis(_rivers(c).filter("fid % 5 = 0"), 100.0)
    return wide.select("fid", F.round("area", 1).alias("area"))


@query("river_split", f"SELECT fid, round(CASE WHEN least(xmax - xmin, ymax - ymin) > 100 THEN {_ROUND} ELSE (xmax - xmin) * (ymax - ymin) END, 1) AS narrow FROM v_poly WHERE fid % 5 = 0", P)
def _(c):
    """What the barrier leaves of each river."""
    return channel.opening(_rivers(c).filter("fid % 5 = 0"), 100.0).select("fid", F.round("rest", 1).alias("narrow"))


@query("river_analysis", f"SELECT fid, CASE WHEN {_LONG} AND ymax - ymin < 100 THEN round(ymax - ymin, 3) END AS width, CASE WHEN {_LONG} AND ymax - ymin < 100 THEN true END AS straight FROM v_poly", P)
def _(c):
    """Narrow legs of all boxes; those of long boxes run along the middle but for the ends, and have the box's width, or there are none."""
    _, narrow = channel.analysis(_rivers(c), 100.0, 50.0)
    g = narrow.groupBy("fid").agg(F.percentile("width", F.lit(0.5)).alias("width"), F.percentile(F.abs(F.col("y2") - F.col("y1")), F.lit(0.5)).alias("d"))
    return c.poly.hint("merge").join(g, "fid", "left").select("fid", F.when(F.expr(_LONG), F.round("width", 3)).alias("width"), F.when(F.expr(_LONG), F.col("d") < 1e-6).alias("straight"))


def _path(n: int, y, width):
    """n stations 50 m apart, y and width by number."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 50.0).alias("x"), y(i).alias("y"), width(i).alias("width")))


@query("trim_taper", "SELECT fid, CAST(20 - fid % 4 - fid % 3 AS INT) AS n, (fid % 4) * 5e1 AS x0 FROM v_poly", P)
def _(c):
    """Ends of up to three narrow stations go, others stay."""
    zero = lambda i: F.lit(0.0)
    path = _path(20, zero, lambda i: F.when((i < F.col("fid") % 4) | (i >= 20 - F.col("fid") % 3), 30.0).otherwise(100.0))
    cut = spread(c.poly.select("fid")).select("fid", path.alias("p")).select("fid", channel.repaired("p", None, "taper").alias("p"))
    return cut.select("fid", F.size("p").alias("n"), F.col("p")[0]["x"].alias("x0"))


@query("trim_hooks", "SELECT fid, CAST(20 AS INT) AS n, CASE WHEN fid % 2 = 0 THEN 5e1 ELSE 0 END AS x0 FROM (SELECT fid FROM v_poly) t", P)
def _(c):
    """A first station that lies beyond the third makes the line turn back at the second: it goes, and so does nothing else."""
    plain = _path(20, lambda i: F.lit(0.0), lambda i: F.lit(100.0))
    back = F.concat(F.array(F.struct(F.lit(130.0).alias("x"), F.lit(20.0).alias("y"), F.lit(100.0).alias("width"))), F.slice(_path(21, lambda i: F.lit(0.0), lambda i: F.lit(100.0)), 2, 20))
    cut = spread(c.poly.select("fid")).select("fid", F.when(F.col("fid") % 2 == 0, back).otherwise(plain).alias("p")).select("fid", channel.repaired("p", None, "hooks").alias("p"))
    return cut.select("fid", F.size("p").alias("n"), F.col("p")[0]["x"].alias("x0"))


@query("densify_line", "SELECT fid, CAST(CASE WHEN fid % 2 = 0 THEN 3 ELSE 2 END AS INT) AS n, CASE WHEN fid % 2 = 0 THEN 5e0 END AS y FROM v_poly", P)
def _(c):
    """Between the arms of a U, whose base is 10 m high, a leg leaves the water: it gets a station in the base."""
    u = F.array(polygons.ring(*[(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (60, 0), (60, 100), (40, 100), (40, 10), (20, 10), (20, 100), (0, 100))]))
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(20.0).alias("width"))
    path = F.when(F.col("fid") % 2 == 0, F.array(at(10.0, 12.0), at(50.0, 12.0))).otherwise(F.array(at(10.0, 30.0), at(10.0, 80.0)))
    got = spread(c.poly.select("fid")).select("fid", u.alias("u"), path.alias("p")).select("fid", channel.repaired("p", "u", "densify").alias("p"))
    return got.select("fid", F.size("p").alias("n"), F.when(F.size("p") == 3, F.col("p")[1]["y"]).alias("y"))


@query("geometry_fix", "SELECT fid, CASE WHEN fid % 3 = 0 THEN 'made_valid' WHEN fid % 3 = 1 THEN 'discarded' END AS fix_type, CASE WHEN fid % 3 = 1 THEN 0 ELSE (xmax - xmin) * (ymax - ymin) END AS area FROM v_poly", P)
def _(c):
    """Turned rings with a repeated point, rings without area, and valid ones."""
    turned = polygons.ring(("xmin", "ymin"), ("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymax"), ("xmax", "ymin"))
    flat = polygons.ring(("xmin", "ymin"), ("xmax", "ymin"), ("xmin", "ymin"))
    plain = polygons.ring(("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))
    rings = F.array(F.when(F.col("fid") % 3 == 0, turned).when(F.col("fid") % 3 == 1, flat).otherwise(plain))
    fixed = spread(c.poly).select("fid", polygons.repair(rings).alias("g"))
    return fixed.select("fid", "g.fix_type", polygons.area(F.col("g.rings")).alias("area"))


@query("reach_length", "SELECT fid, round(greatest(xmax - xmin, ymax - ymin), 4) AS reach_m FROM v_poly", P)
def _(c):
    w = F.least(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return c.poly.select("fid", F.round((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) / w, 4).alias("reach_m"))


@query("fit_arc", "SELECT fid, xmin + 50 AS cx, ymin - 20 AS cy, 100e0 + fid % 7 AS radius FROM v_poly", P)
def _(c):
    r = 100.0 + F.col("fid") % 7
    a = F.explode(F.array(*[F.lit(x) for x in (0.1, 0.5, 1.0, 1.7, 2.2)]))
    pts = c.poly.withColumn("a", a).select("fid", (F.col("xmin") + 50 + r * F.cos("a")).alias("x"), (F.col("ymin") - 20 + r * F.sin("a")).alias("y"))
    return rivers.fit_circle(pts).select("fid", *[F.round(n, 4).alias(n) for n in ("cx", "cy", "radius")])


@query("effective_length", "SELECT l.fid, round(sqrt(dx1 * dx1 + dy1 * dy1) * count(*) FILTER (WHERE x1 + t * dx1 >= 5000 AND x1 + t * dx1 < 15000) / 9, 4) AS inside_m FROM v_line l CROSS JOIN (SELECT (unnest(range(0, 9)) + 5e-1) / 9 AS t) s GROUP BY l.fid, dx1, dy1", ("line",))
def _(c):
    x = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.col("x1") + (i + 0.5) / 9.0 * F.col("dx1"))
    n = F.size(F.filter(x, lambda v: (v >= 5000) & (v < 15000)))
    return c.line.select("fid", F.round(F.hypot("dx1", "dy1") * n / 9, 4).alias("inside_m"))


def _edges(c):
    """The four sides of the rectangles, in order."""
    from terraloom.functions.geometry import rectangle_ring

    ring = rectangle_ring(*map(F.col, ("xmin", "ymin", "xmax", "ymax")))
    e = c.poly.select("fid", F.explode(F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, 2, 3), F.slice(ring, 1, 1)).alias("b"))).alias("e"))
    return e.select("fid", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def main_axis(edges):
    """(fid, angle): direction in degrees, -90 up to 90, of the largest spread of edge midpoints weighted by edge length."""
    e = edges.withColumns({"w": F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), "mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})
    m = e.groupBy("fid").agg((F.sum(F.col("w") * F.col("mx")) / F.sum("w")).alias("cx"), (F.sum(F.col("w") * F.col("my")) / F.sum("w")).alias("cy"))
    u, v = F.col("mx") - F.col("cx"), F.col("my") - F.col("cy")
    s = e.join(m, "fid").groupBy("fid").agg(F.sum(F.col("w") * u * u).alias("xx"), F.sum(F.col("w") * v * v).alias("yy"), F.sum(F.col("w") * u * v).alias("xy"))
    return s.select("fid", F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2).alias("angle"))


@query("pca_axis", "SELECT fid, CASE WHEN xmax - xmin > ymax - ymin THEN 0e0 ELSE 90e0 END AS angle FROM v_poly WHERE xmax - xmin <> ymax - ymin", P)
def _(c):
    return main_axis(_edges(c).join(c.poly.filter("xmax - xmin <> ymax - ymin").select("fid"), "fid")).select("fid", F.abs(F.round("angle", 4)).alias("angle"))


@query("chords", "SELECT fid, xmin AS x_from, xmax AS x_to FROM v_poly", P)
def _(c):
    mid = c.poly.select("fid", ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))
    hit = _edges(c).join(mid, "fid").filter("(y1 > y) <> (y2 > y)")
    at = hit.withColumn("x", F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    xs = at.groupBy("fid").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.get("xs", 2 * k).alias("a"), F.get("xs", 2 * k + 1).alias("b")))
    return xs.withColumn("p", F.explode(pairs)).select("fid", F.col("p.a").alias("x_from"), F.col("p.b").alias("x_to"))
