"""Polylines: lengths, positions, fixed-length segments with azimuths, smoothing and islands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.functions import cost
from terraloom.operators import paths

SEGMENT_M = 50.0


def vertices(lines: DataFrame, key: str = "fid", coords: str = "coords") -> DataFrame:
    """(key, i, x, y) of an array of struct<x, y>."""
    return lines.select(key, F.posexplode(coords).alias("i", "p")).select(key, "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def cumulative(points: DataFrame, key: str = "fid") -> DataFrame:
    """Distance along the line up to each vertex."""
    w = W.partitionBy(key).orderBy("i")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return points.withColumn("step", step).withColumn("along", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))


def with_lengths(coords: Column) -> Column:
    """Array of struct<x, y, along>, within generated code."""
    start = F.array(F.struct(coords[0]["x"].alias("x"), coords[0]["y"].alias("y"), F.lit(0.0).alias("along")))

    def add(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        return F.concat(out, F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"), (last["along"] + F.hypot(p["x"] - last["x"], p["y"] - last["y"])).alias("along"))))

    return F.aggregate(F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))), start, add)


def at_distance(path: Column, distance: Column) -> Column:
    """struct<x, y> at a distance along an array with lengths; clamped to the ends, the start of a segment without length."""
    last = F.element_at(path, -1)
    i = F.size(F.filter(path, lambda p: p["along"] <= distance))
    a, b = F.element_at(path, F.greatest(i, F.lit(1))), F.element_at(path, F.least(i + 1, F.size(path)))
    t = F.coalesce((distance - a["along"]) / F.nullif(b["along"] - a["along"], F.lit(0.0)), F.lit(0.0))
    make = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.when(distance >= last["along"], make(last["x"], last["y"])).when(distance <= 0, make(path[0]["x"], path[0]["y"])).otherwise(make(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"])))


def segment(lines: DataFrame, key: str = "fid", coords: str = "coords", length: float = SEGMENT_M) -> DataFrame:
    """Pieces of fixed length: chords between points along the line; chords under 1 cm go and don't count in i. Nothing is shuffled."""
    cut = F.arrow_udf(paths.segments(length), paths.SEGMENT)
    return lines.select("*", F.explode(cut(coords)).alias("_s")).select(*[F.col(f"`{c}`") for c in lines.columns], "_s.*")


def linear_cross(lines: DataFrame, rules: DataFrame, coords: str = "coords") -> DataFrame:
    """Crossing index: segments of the lines whose rule sets an angle or a price. Ids are unique across the parts of a line."""
    priced = lines.join(F.broadcast(rules), "rule_id").withColumn("base_cost", cost.base_cross_cost()).filter(F.col("min_angle").isNotNull() | (F.col("base_cost") > 0))
    cut = segment(priced, "fid", coords)
    part = F.col("part") if "part" in lines.columns else F.lit(0)
    return cut.withColumn("segment_id", F.concat_ws("_", F.lit("seg"), "fid", part, "i")).withColumn("parent_feature_id", F.concat(F.lit("feat_"), F.col("fid")))


def crossing_windows(segments: DataFrame) -> DataFrame:
    return segments.select("segment_id", "rule_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))


def smooth(points: DataFrame, k: int = 2, key: str = "fid") -> DataFrame:
    """Symmetric moving average whose half-width shrinks to the distance from the nearer end, so ends stay."""
    w = W.partitionBy(key).orderBy("i")
    numbered = points.withColumn("_j", F.row_number().over(w) - 1).withColumn("_m", F.count("*").over(W.partitionBy(key)) - 1)
    half = F.least(F.lit(k), F.col("_j"), F.col("_m") - F.col("_j"))
    out = {}
    for c in ("x", "y"):
        choice = F.col(c)
        for h in range(1, k + 1):
            choice = F.when(half == h, F.avg(c).over(w.rowsBetween(-h, h))).otherwise(choice)
        out[f"s{c}"] = choice
    return numbered.withColumns(out).drop("_j", "_m")


def tangents(points: DataFrame, key: str = "fid") -> DataFrame:
    """Unit central differences, one-sided at the ends."""
    w = W.partitionBy(key).orderBy("i")
    dx = F.coalesce(F.lead("x").over(w), F.col("x")) - F.coalesce(F.lag("x").over(w), F.col("x"))
    dy = F.coalesce(F.lead("y").over(w), F.col("y")) - F.coalesce(F.lag("y").over(w), F.col("y"))
    size = F.hypot("_dx", "_dy")
    return points.withColumns({"_dx": dx, "_dy": dy}).withColumns({"tx": F.coalesce(F.col("_dx") / F.nullif(size, F.lit(0.0)), F.lit(0.0)), "ty": F.coalesce(F.col("_dy") / F.nullif(size, F.lit(0.0)), F.lit(0.0))}).drop("_dx", "_dy")


def rolling_median(rows: DataFrame, value: str, key: str, order: str, half: int = 2) -> DataFrame:
    return rows.withColumn("median", F.percentile(value, F.lit(0.5)).over(W.partitionBy(key).orderBy(order).rowsBetween(-half, half)))


def islands(points: DataFrame, interval_m: float, key: str = "fid", jump: float = 2.5, turn_deg: float = 135.0, width: str | None = None) -> DataFrame:
    """Splits a line where a step is too long and on both sides of a point where it turns back; islands of one point go.

    A point at which the line turns back, but which lies less than 0.6 of the
    width (of the median step, where there is none) beside the line between its
    neighbours, is a jitter: it goes instead, unless a step to it is too long.
    Turns are compared by products of steps, without angles, so whole numbers
    are compared exactly.
    """
    w = W.partitionBy(key).orderBy("i")
    share = round(math.cos(math.radians(turn_deg)) ** 2, 12)

    def steps(df: DataFrame) -> DataFrame:
        df = df.withColumns({f"_d{c}": F.col(c) - F.lag(c).over(w) for c in ("x", "y")}).withColumns({f"_e{c}": F.lead(f"_d{c}").over(w) for c in ("x", "y")})
        dot, p, q = F.expr("_dx * _ex + _dy * _ey"), F.expr("_dx * _dx + _dy * _dy"), F.expr("_ex * _ex + _ey * _ey")
        limit = share * p * q
        back = (dot < 0) & (dot * dot > limit) if turn_deg >= 90 else (dot < 0) | (dot * dot < limit)
        return df.withColumns({"_p": p, "_q": q, "_back": F.coalesce(back & (p > 0) & (q > 0), F.lit(False))}).withColumn("_s", F.sqrt("_p"))

    a = steps(points).withColumn("_mid", F.percentile("_s", F.lit(0.5)).over(W.partitionBy(key)))
    a = a.withColumn("_jump", F.greatest(F.lit(jump * interval_m), 3 * F.col("_mid")))
    vx, vy = F.col("_dx") + F.col("_ex"), F.col("_dy") + F.col("_ey")
    off = F.abs(F.col("_dx") * vy - F.col("_dy") * vx) / F.sqrt(F.nullif(vx * vx + vy * vy, F.lit(0.0)))
    beside = F.when(F.col(width) > 0, F.col(width)).otherwise(F.col("_mid")) if width else F.col("_mid")
    jitter = F.col("_back") & (off < 0.6 * beside) & (F.greatest("_s", F.sqrt("_q")) <= F.col("_jump"))
    b = steps(a.filter(~F.coalesce(jitter, F.lit(False))))
    cut = (F.col("_s") > F.col("_jump")) | F.col("_back") | F.lag("_back").over(w)
    c = b.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("island", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return c.withColumn("_n", F.count("*").over(W.partitionBy(key, "island"))).filter("_n >= 2").select(*points.columns, "island")


def drop_outside_ends(points: DataFrame, inside: str, key: str = "fid") -> DataFrame:
    """Cuts a line to the stretch between its first and last inner point; inner outliers stay."""
    p = W.partitionBy(key)
    lo, hi = F.min(F.when(F.col(inside), F.col("i"))).over(p), F.max(F.when(F.col(inside), F.col("i"))).over(p)
    return points.withColumn("_lo", lo).withColumn("_hi", hi).filter("i BETWEEN _lo AND _hi").drop("_lo", "_hi")
