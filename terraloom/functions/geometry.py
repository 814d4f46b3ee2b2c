"""Planar geometry as columns: everything here stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def azimuth(x1, y1, x2, y2) -> Column:
    """Degrees clockwise from north, 0 up to 360."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)) + 360.0, F.lit(360.0))


def crossing_angle(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 180.0
    return F.least(d, 180.0 - d)


def angle_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 360.0
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of struct<x, y>; closing the ring is optional."""
    n = F.size(ring)

    def term(i: Column) -> Column:
        a, b = F.element_at(ring, (i + 1).cast("int")), F.element_at(ring, (F.pmod(i + 1, n) + 1).cast("int"))
        return a["x"] * b["y"] - b["x"] * a["y"]

    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0.0), lambda s, t: s + t)) / 2)


def rectangle_ring(xmin, ymin, xmax, ymax) -> Column:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax))


def polyline_length(line: Column) -> Column:
    step = F.transform(F.sequence(F.lit(2), F.size(line)), lambda i: F.hypot(F.element_at(line, i)["x"] - F.element_at(line, i - 1)["x"], F.element_at(line, i)["y"] - F.element_at(line, i - 1)["y"]))
    return F.when(F.size(line) < 2, 0.0).otherwise(F.aggregate(step, F.lit(0.0), lambda s, t: s + t))


def overlap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a_max, b_max) - F.greatest(a_min, b_min))


def clipped_length(x1, y1, x2, y2, xmin, ymin, xmax, ymax) -> Column:
    """Length of a segment inside a rectangle (Liang and Barsky)."""
    dx, dy = x2 - x1, y2 - y1

    def span(p: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        a, b = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
        inside = (p >= lo) & (p <= hi)
        return (
            F.when(d != 0, F.least(a, b)).when(inside, F.lit(0.0)).otherwise(F.lit(2.0)),
            F.when(d != 0, F.greatest(a, b)).when(inside, F.lit(1.0)).otherwise(F.lit(-1.0)),
        )

    (ax, bx), (ay, by) = span(x1, dx, xmin, xmax), span(y1, dy, ymin, ymax)
    return F.greatest(F.lit(0.0), F.least(bx, by, F.lit(1.0)) - F.greatest(ax, ay, F.lit(0.0))) * F.hypot(dx, dy)


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.nullif(size, F.lit(0.0))))).otherwise(0.0)
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))
