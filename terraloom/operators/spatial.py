"""Spatial joins on square bins: equi-joins on a cell, then the exact test. No pair is compared outside its bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.geometry import overlap
from terraloom.storage import table


def _bin(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def in_cells(boxes: DataFrame, size: float) -> DataFrame:
    """A row for every bin that a box touches."""
    span = lambda lo, hi: F.sequence(_bin(F.col(lo), size), _bin(F.col(hi), size))
    return boxes.withColumn("_cx", F.explode(span("xmin", "xmax"))).withColumn("_cy", F.explode(span("ymin", "ymax")))


def box_pairs(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs (columns of a with prefix a_, of b with prefix b_) of boxes that overlap, each once: in the bin of the overlap's corner."""
    left = in_cells(a, size).select(*[F.col(c).alias(f"a_{c}") for c in a.columns], "_cx", "_cy")
    right = in_cells(b, size).select(*[F.col(c).alias(f"b_{c}") for c in b.columns], "_cx", "_cy")
    hit = (F.col("a_xmin") < F.col("b_xmax")) & (F.col("b_xmin") < F.col("a_xmax")) & (F.col("a_ymin") < F.col("b_ymax")) & (F.col("b_ymin") < F.col("a_ymax"))
    once = (_bin(F.greatest("a_xmin", "b_xmin"), size) == F.col("_cx")) & (_bin(F.greatest("a_ymin", "b_ymin"), size) == F.col("_cy"))
    return left.join(right, ["_cx", "_cy"]).filter(hit & once).drop("_cx", "_cy")


def overlap_area() -> Column:
    return overlap(F.col("a_xmin"), F.col("a_xmax"), F.col("b_xmin"), F.col("b_xmax")) * overlap(F.col("a_ymin"), F.col("a_ymax"), F.col("b_ymin"), F.col("b_ymax"))


def expanded(pairs: DataFrame, a: str, b: str, chunk: int = 512) -> DataFrame:
    """Pairs of arrays a and b as pairs of their elements, in columns a and b. Arrays are cut into chunks and dealt out first, so no task makes all pairs of a long one."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0)).cast("int"), F.lit(chunk)), lambda i: F.slice(c, i + 1, chunk)))
    return pairs.withColumn(a, cut(a)).withColumn(b, cut(b)).repartition(n).withColumn(a, F.explode(a)).withColumn(b, F.explode(b))


def pair_boxes(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_xmin ... b_ymax, a_fids, b_fids): pairs of overlapping boxes, equal boxes as one with the array of their fids."""
    box = ["xmin", "ymin", "xmax", "ymax"]
    left, right = (d.groupBy(*box).agg(F.collect_list("fid").alias("fids")) for d in (a, b))
    pairs = box_pairs(left.select(*box), right.select(*box), size)
    lists = lambda d, p: d.select(*[F.col(c).alias(f"{p}_{c}") for c in (*box, "fids")])
    return pairs.join(lists(left, "a"), [f"a_{c}" for c in box]).join(lists(right, "b"), [f"b_{c}" for c in box])


def spots(points: DataFrame) -> DataFrame:
    """(x, y, fids) of the places of points (fid, x, y), with the fids at each; points without a place have none."""
    known = points.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    return known.groupBy("x", "y").agg(F.collect_list("fid").alias("fids"))


def _near_spots(own: DataFrame, cutoff: float) -> DataFrame:
    """(ax, ay, bx, by, d) of distinct places (x, y) no farther apart than cutoff, each pair once: bins of that size and their neighbours."""
    own = own.select("x", "y", _bin(F.col("x"), cutoff).alias("cx"), _bin(F.col("y"), cutoff).alias("cy"))
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    wide = own.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step)).select("x", "y", F.col("cx") + F.col("_i"), F.col("cy") + F.col("_j"))
    a, b = wide.toDF("ax", "ay", "cx", "cy"), own.toDF("bx", "by", "cx", "cy")
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return a.join(b, ["cx", "cy"]).filter("ax < bx OR (ax = bx AND ay < by)").withColumn("d", d).filter(F.col("d") <= cutoff).select("ax", "ay", "bx", "by", "d")


def within(points: DataFrame, cutoff: float, distance=lambda d: d) -> DataFrame:
    """Pairs (a, b, ax, ay, bx, by, d) with a < b of points (fid, x, y) no farther apart than cutoff.

    Distances are taken between places, not points: as many points as lie at a
    place share them. `distance` is applied to them before they are spread.
    """
    own = table(spots(points), "spots")
    lists = lambda p, c: own.select(F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"), F.col("fids").alias(c))
    apart = _near_spots(own, cutoff).join(lists("a", "_a"), ["ax", "ay"]).join(lists("b", "_b"), ["bx", "by"])
    same = own.filter("size(fids) > 1").select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"), F.lit(0.0).alias("d"), F.col("fids").alias("_a"), F.col("fids").alias("_b"))
    turned = lambda k: F.when(F.col("_a") < F.col("_b"), F.col(f"a{k}")).otherwise(F.col(f"b{k}"))
    back = lambda k: F.when(F.col("_a") < F.col("_b"), F.col(f"b{k}")).otherwise(F.col(f"a{k}"))
    cut = lambda pairs: expanded(pairs.withColumn("d", distance(F.col("d"))), "_a", "_b")
    ends = [F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), turned("x").alias("ax"), turned("y").alias("ay"), back("x").alias("bx"), back("y").alias("by"), "d"]
    return cut(apart).filter("_a <> _b").select(*ends).unionByName(cut(same).filter("_a < _b").select(*ends))


def linked(points: DataFrame, cutoff: float) -> DataFrame:
    """(v, c) as graph.components gives it for the pairs within(points, cutoff), without listing them.

    Points of a bin two thirds of the cutoff wide are all linked, so bins are
    the vertices, joined where two of their places are near enough. An id that
    lies in several bins joins them.
    """
    from terraloom.operators.graph import components

    size = cutoff / 1.5
    cell = _bin(F.col("x"), size) * F.lit(1 << 32) + _bin(F.col("y"), size)
    own = table(points.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select("fid", "x", "y", cell.alias("cell")), "linked-points")
    places = own.select("x", "y", "cell").distinct()
    pairs = _near_spots(places.select("x", "y"), cutoff)
    at = lambda p: _bin(F.col(f"{p}x"), size) * F.lit(1 << 32) + _bin(F.col(f"{p}y"), size)
    apart = pairs.select(at("a").alias("a"), at("b").alias("b")).filter("a <> b").distinct()
    first = own.groupBy("fid").agg(F.min("cell").alias("a"), F.max("cell").alias("b")).filter("a < b").select("fid", "a")
    again = own.join(first, "fid").select("a", F.col("cell").alias("b")).filter("a <> b").distinct()
    labels = components(apart.unionByName(again))
    cells = own.groupBy("cell").agg(F.min("fid").alias("lo"), F.max("fid").alias("hi")).join(labels, F.col("cell") == F.col("v"), "left").select("cell", F.coalesce("c", "cell").alias("k"), "lo", "hi")
    whole = cells.groupBy("k").agg(F.min("lo").alias("c"), F.max("hi").alias("_hi")).filter("c < _hi").select("k", "c")
    return own.join(cells.select("cell", "k").join(whole, "k"), "cell").select(F.col("fid").alias("v"), "c").distinct()


def nearest(points: DataFrame, others: DataFrame, key: str, value: str, start: float = 500.0, same: bool = False) -> DataFrame:
    """(fid, key, value, distance) for each point (fid, x, y, key): the nearest of the others (key, sid, x, y, value) of its key, lower sid on ties.

    Places look, not points, and of the others at a place only the lowest two
    sids matter. Places look in bins of a size and their neighbours; those that
    find none look again in bins four times as wide, so each finds its nearest
    one however far it is, and none is compared with all. The first size follows
    the density of the others, `start` at most. With `same`, sid = fid is left out.
    """
    known = "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"
    left = table(points.filter(known).select("fid", key, "x", "y"), "nearest-left")
    two = F.slice(F.array_sort(F.collect_set(F.struct("sid", F.col(value).alias("value")))), 1, 2)
    # First the two lowest of each 64th of a place's sids, so that no place is gathered whole.
    part = others.filter(known).withColumn("_p", F.pmod(F.xxhash64("sid"), F.lit(64))).groupBy(key, "x", "y", "_p").agg(two.alias("s")).select(key, "x", "y", F.explode("s").alias("s"))
    right = table(part.select(key, "x", "y", "s.sid", F.col("s.value").alias(value)).groupBy(key, "x", "y").agg(two.alias("s")).select(key, F.col("x").alias("_x"), F.col("y").alias("_y"), "s"), "nearest-others")
    ends = left.select("x", "y").union(right.select("_x", "_y")).agg(*[f(c) for c in ("x", "y") for f in (F.max, F.min)]).first()
    wide = [(ends[k] or 0.0) - (ends[k + 1] or 0.0) for k in (0, 2)]
    n, kinds = right.count(), max(1, right.select(key).distinct().count())
    size = start
    if n and wide[0] * wide[1] > 0:
        size = min(start, max(1e-6 * max(wide), (4 * wide[0] * wide[1] * kinds / n) ** 0.5))
    span = max(start, *wide) * 1.5
    found, step = None, F.array(F.lit(-1), F.lit(0), F.lit(1))
    shape = f"{key}, _x AS x, _y AS y, s"
    if same:
        here = left.join(right.selectExpr(*shape.split(", ")), [key, "x", "y"], "left").withColumn("o", F.get(F.filter("s", lambda v: v["sid"] != F.col("fid")), F.lit(0)))
        here = table(here.select("fid", key, "x", "y", "o"), "nearest-here")
        found = here.filter("o IS NOT NULL").select("fid", key, F.struct(F.lit(0.0).alias("_d"), "o.sid", "o.value").alias("_m"))
        left = here.filter("o IS NULL").select("fid", key, "x", "y")
        who = ["fid", key, "x", "y"]
    else:
        who = [key, "x", "y"]
    looks = table(left.select(*who).distinct(), "nearest-places")
    answers = None
    while True:
        a = looks.withColumns({"_i": F.explode(step)}).withColumn("_j", F.explode(step)).withColumns({"_cx": _bin(F.col("x"), size) + F.col("_i"), "_cy": _bin(F.col("y"), size) + F.col("_j")})
        b = right.withColumns({"_cx": _bin(F.col("_x"), size), "_cy": _bin(F.col("_y"), size)})
        if not same:
            b = b.withColumn("o", F.get("s", F.lit(0)))
        d = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
        met = a.join(b, [key, "_cx", "_cy"]).withColumn("_d", d).filter(F.col("_d") <= size)
        if same:
            met = met.withColumn("o", F.get(F.filter("s", lambda v: v["sid"] != F.col("fid")), F.lit(0))).filter("o IS NOT NULL")
        hit = met.groupBy(*who).agg(F.min(F.struct("_d", "o.sid", "o.value")).alias("_m"))
        hit = table(hit, "nearest-found")
        answers = hit if answers is None else answers.unionByName(hit)
        if size > span:
            break
        looks = table(looks.join(hit.select(*who), who, "left_anti"), "nearest-places")
        if looks.isEmpty():
            break
        size *= 4
    each = found.unionByName(answers.select("fid", key, "_m")) if same else left.join(answers, who).select("fid", key, "_m")
    return each.groupBy("fid", key).agg(F.min("_m").alias("_m")).select("fid", key, F.col("_m.value").alias(value), F.col("_m._d").alias("distance"))


def at_places(points: DataFrame, find) -> DataFrame:
    """fid of the points (fid, x, y) whose place find() gives; it gets the distinct places, whose fid is the place itself, and gives a frame with fids."""
    places = points.select("x", "y").distinct().select(F.struct("x", "y").alias("fid"), "x", "y")
    hit = find(places).select("fid").distinct().select("fid.x", "fid.y")
    return points.join(hit, ["x", "y"], "left_semi").select("fid").distinct()


def inside_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a ring, an array of struct<x, y>: parity of crossings, lower and left borders in."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, (i + 1).cast("int")), F.element_at(ring, (F.pmod(i + 1, n) + 1).cast("int"))
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Pairs (fid of the point, pid) for polygons (pid, ring, xmin ... ymax) that hold a point (fid, x, y)."""
    cells = in_cells(polygons, size)
    p = points.select("fid", "x", "y", _bin(F.col("x"), size).alias("_cx"), _bin(F.col("y"), size).alias("_cy"))
    box = (F.col("x") >= F.col("xmin")) & (F.col("x") <= F.col("xmax")) & (F.col("y") >= F.col("ymin")) & (F.col("y") <= F.col("ymax"))
    return p.join(cells, ["_cx", "_cy"]).filter(box).filter(inside_ring(F.col("ring"), F.col("x"), F.col("y"))).select("fid", "pid")


def bounds(boxes: DataFrame, *keys: str) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def expand(ratio: float = 0.0, fixed: float = 0.0, least: float = 100.0) -> dict[str, Column]:
    """A box grown on each side by a share of its sides, of 100 m at least, or by a fixed margin."""
    dx, dy = F.greatest(F.col("xmax") - F.col("xmin"), F.lit(least)), F.greatest(F.col("ymax") - F.col("ymin"), F.lit(least))
    return {"xmin": F.col("xmin") - dx * ratio - fixed, "ymin": F.col("ymin") - dy * ratio - fixed, "xmax": F.col("xmax") + dx * ratio + fixed, "ymax": F.col("ymax") + dy * ratio + fixed}


def enclave_filter(boxes: DataFrame, centre: DataFrame, radius: float) -> DataFrame:
    """Boxes whose centre is within radius of the one row (cx, cy) of centre; all of them if none is."""
    d = F.hypot((F.col("xmin") + F.col("xmax")) / 2 - F.col("cx"), (F.col("ymin") + F.col("ymax")) / 2 - F.col("cy"))
    near = boxes.crossJoin(F.broadcast(centre)).withColumn("_near", d <= radius)
    some = near.agg(F.coalesce(F.bool_or("_near"), F.lit(False)).alias("_some"))
    return near.crossJoin(F.broadcast(some)).filter("_near OR NOT _some").select(*boxes.columns)
