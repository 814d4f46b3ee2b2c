"""Grids in long form (r, c, value): rasterising, resampling, neighbourhoods and map algebra."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.functions import cost
from terraloom.rules import FORBIDDEN


def cells(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    n = spark.range(rows * cols)
    return n.select((F.col("id") / cols).cast("long").cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))


def shape(xmin: float, ymin: float, xmax: float, ymax: float, res: float) -> tuple[int, int, float, float]:
    """(rows, columns, cell width, cell height): the count is rounded up, so cells may be smaller than res."""
    import math

    h, w = max(1, math.ceil((ymax - ymin) / res)), max(1, math.ceil((xmax - xmin) / res))
    return h, w, (xmax - xmin) / w, (ymax - ymin) / h


def centres(grid: DataFrame, xmin: float, ymax: float, dx: float, dy: float) -> DataFrame:
    """Row 0 is the northern one."""
    return grid.withColumn("x", xmin + (F.col("c") + 0.5) * dx).withColumn("y", ymax - (F.col("r") + 0.5) * dy)


def burn(boxes: DataFrame, xmin: float, ymax: float, d: float, rows: int, cols: int) -> DataFrame:
    """A row for every cell whose centre is in a box, lower bound in, upper bound out."""
    first = lambda v: F.ceil(v - 0.5).cast("int")
    c0, c1 = first((F.col("xmin") - xmin) / d), first((F.col("xmax") - xmin) / d) - 1
    r0, r1 = first((F.lit(ymax) - F.col("ymax")) / d), first((F.lit(ymax) - F.col("ymin")) / d) - 1
    a = boxes.withColumns({"_c0": F.greatest(c0, F.lit(0)), "_c1": F.least(c1, F.lit(cols - 1)), "_r0": F.greatest(r0, F.lit(0)), "_r1": F.least(r1, F.lit(rows - 1))}).filter("_c0 <= _c1 AND _r0 <= _r1")
    return a.withColumn("r", F.explode(F.sequence("_r0", "_r1"))).withColumn("c", F.explode(F.sequence("_c0", "_c1"))).drop("_c0", "_c1", "_r0", "_r1")


def reduce_to(fine: DataFrame, factor: int, reducer: str, value: str = "v") -> DataFrame:
    """Cells of a coarser grid by one of max, min, avg, mode, median, nearest (the cell at the middle)."""
    to = fine.select((F.col("r") / factor).cast("int").alias("r"), (F.col("c") / factor).cast("int").alias("c"), F.col(value).alias("v"), (F.col("r") % factor).alias("_i"), (F.col("c") % factor).alias("_j"))
    middle = factor // 2
    how = {"max": F.max("v"), "min": F.min("v"), "avg": F.avg("v"), "mode": F.mode("v", True), "median": F.percentile("v", F.lit(0.5)), "nearest": F.max(F.when((F.col("_i") == middle) & (F.col("_j") == middle), F.col("v")))}
    return to.groupBy("r", "c").agg(how[reducer].alias("v"))


def window_sums(grid: DataFrame, half: int, *values: str) -> DataFrame:
    """Sums of columns over the square of 2 * half + 1 cells around each cell, by two running passes. The grid is dense."""
    along = W.partitionBy("r").orderBy("c").rowsBetween(-half, half)
    down = W.partitionBy("c").orderBy("r").rowsBetween(-half, half)
    out = grid.withColumns({f"_{v}": F.sum(v).over(along) for v in values})
    return out.withColumns({f"sum_{v}": F.sum(f"_{v}").over(down) for v in values}).drop(*[f"_{v}" for v in values])


def slope(grid: DataFrame, res: float, value: str = "elev") -> DataFrame:
    """Degrees by central differences, one-sided at borders, after invalid cells are set to 0; null on invalid cells and their four neighbours."""
    row, col = W.partitionBy("r").orderBy("c"), W.partitionBy("c").orderBy("r")
    z = grid.withColumn("_z", F.coalesce(value, F.lit(0.0))).withColumn("_bad", F.col(value).isNull())

    def gradient(w) -> Column:
        before, after = F.lag("_z").over(w), F.lead("_z").over(w)
        return F.when(before.isNull(), (after - F.col("_z")) / res).when(after.isNull(), (F.col("_z") - before) / res).otherwise((after - before) / (2 * res))

    near = F.col("_bad")
    for w in (row, col):
        near = near | F.coalesce(F.lag("_bad").over(w), F.lit(False)) | F.coalesce(F.lead("_bad").over(w), F.lit(False))
    a = z.withColumn("_gx", gradient(row)).withColumn("_gy", gradient(col)).withColumn("_near", near)
    return a.withColumn("slope", F.when(~F.col("_near"), F.degrees(F.atan(F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2))))).drop("_z", "_bad", "_gx", "_gy", "_near")


def tpi(grid: DataFrame, half: int, value: str = "elev", share: float = 0.1) -> DataFrame:
    """Height over the mean of the valid cells around, where more than a share of them is valid; valleys and peaks beyond 30 m."""
    a = grid.withColumn("_v", F.coalesce(value, F.lit(0.0))).withColumn("_k", F.col(value).isNotNull().cast("double"))
    s = window_sums(a, half, "_v", "_k")
    area = float((2 * half + 1) ** 2)
    t = F.when(F.col(value).isNotNull() & (F.col("sum__k") > share * area), F.col(value) - F.col("sum__v") / F.col("sum__k"))
    out = s.withColumn("tpi", t).drop("_v", "_k", "sum__v", "sum__k")
    return out.withColumn("valley", F.coalesce(F.col("tpi") < -30, F.lit(False))).withColumn("peak", F.coalesce(F.col("tpi") > 30, F.lit(False)))


def nodata(value: Column, declared: float | None) -> Column:
    odd = value.isNull() | F.isnan(value) | (F.abs(value) > 1e6) | (value < -1000) | (value > 9000)
    return odd if declared is None else odd | (value == declared)


def passage_costs(grid: DataFrame) -> DataFrame:
    """lpcf from guide, forbidden, reward, excluded (800 kV zone), peak and adder, in this order, so that rewards and adders also move forbidden cells."""
    v = F.greatest(F.lit(1.0), F.coalesce("guide", F.lit(1.0)))
    v = F.when(F.coalesce("forbidden", F.lit(False)), FORBIDDEN).otherwise(v)
    v = v - 0.001 * F.coalesce("reward", F.lit(0.0))
    v = F.when(F.coalesce("excluded", F.lit(False)), F.greatest(v, F.lit(500.0))).otherwise(v)
    v = F.when(F.coalesce("peak", F.lit(False)), v - 0.03).otherwise(v)
    return grid.withColumn("lpcf", v + F.coalesce("adder", F.lit(0.0)))


def tower_costs(grid: DataFrame) -> DataFrame:
    """tscf from tower_guide, tower_mult and no_tower."""
    v = F.greatest(F.lit(1.0), F.coalesce("tower_guide", F.lit(1.0))) * F.coalesce("tower_mult", F.lit(1.0))
    return grid.withColumn("tscf", F.when(F.coalesce("no_tower", F.lit(False)), FORBIDDEN).otherwise(v))


def tower_difficulty(grid: DataFrame) -> DataFrame:
    """From tower_ok (1 or 0), tscf and slope: scarce valid ground around, cost, steepness; 50000 where no tower may stand."""
    around = window_sums(grid.withColumn("_ok", F.col("tower_ok").cast("double")), 2, "_ok")
    v = 0.7 * (1 - F.col("sum__ok") / 25) * 1000 + 0.3 * F.when(F.col("tscf") >= FORBIDDEN, 0.0).otherwise(F.least(F.greatest(F.col("tscf") / 1000, F.lit(0.0)), F.lit(1.0))) * 1000 + 200 * F.greatest(F.coalesce("slope", F.lit(0.0)) - 25, F.lit(0.0))
    return around.withColumn("difficulty", F.when(F.col("tower_ok") == 1, v).otherwise(50000.0)).drop("_ok", "sum__ok")


def distance_to(grid: DataFrame, mark: str) -> DataFrame:
    """Exact distance in cells from each cell to the nearest marked one, null where there is none: down the columns, then along each row.

    The second pass takes the lower envelope of a row's parabolas, so no distance
    is out of reach and a row is the most that a task holds.
    """
    up, down = W.partitionBy("c").orderBy("r").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("c").orderBy("r").rowsBetween(0, W.unboundedFollowing)
    above, below = F.last(F.when(F.col(mark), F.col("r")), True).over(up), F.first(F.when(F.col(mark), F.col("r")), True).over(down)
    heights = grid.select("r", "c", F.least(F.col("r") - above, below - F.col("r")).cast("double").alias("dy"))
    best = heights.groupBy("r").applyInArrow(_row_distances, "r int, c int, distance double")
    return grid.join(best, ["r", "c"], "left")


def _row_distances(rows: pa.Table) -> pa.Table:
    c, dy = rows["c"].to_numpy().astype(np.int64), rows["dy"].fill_null(np.inf).to_numpy()
    order = np.argsort(c)
    at, height = c[order], dy[order] ** 2
    use = np.flatnonzero(np.isfinite(height))
    out = np.full(len(c), np.inf)
    if len(use):
        x, h = at[use].astype(float), height[use]
        top, cut = [0], [-np.inf]
        for k in range(1, len(x)):
            while True:
                j = top[-1]
                meet = ((h[k] + x[k] ** 2) - (h[j] + x[j] ** 2)) / (2 * (x[k] - x[j]))
                if meet > cut[-1] or len(top) == 1:
                    break
                top.pop()
                cut.pop()
            if meet <= cut[-1]:
                top, cut = [k], [-np.inf]
            else:
                top.append(k)
                cut.append(meet)
        own = np.array(top)[np.searchsorted(np.array(cut), at, "right") - 1]
        out[order] = np.sqrt(h[own] + (at - x[own]) ** 2)
    return pa.table([rows["r"].cast(pa.int32()), pa.array(c, pa.int32()), pa.array(out, mask=~np.isfinite(out))], names=["r", "c", "distance"])


def blocks(grid: DataFrame, size: int, high: float = 4.0) -> DataFrame:
    """Blocks of size x size cells: shares of forbidden and of costly cells, least distance, and the class these give."""
    g = grid.groupBy((F.col("r") / size).cast("int").alias("br"), (F.col("c") / size).cast("int").alias("bc"))
    s = g.agg(F.avg(F.col("forbidden").cast("double")).alias("fr"), F.avg(((F.col("lpcf") > high) & (F.col("lpcf") < FORBIDDEN)).cast("double")).alias("hcr"), F.min("distance_m").alias("md"))
    return s.withColumn("kind", block_class(F.col("fr"), F.col("md"), F.col("hcr")))


def block_class(fr: Column, md: Column, hcr: Column) -> Column:
    """dense: much forbidden ground close by, or much costly ground; complex: some of either; open: the rest."""
    d = F.coalesce(md, F.lit(1e9))
    return F.when(((fr > 0.15) & (d < 100)) | (hcr > 0.5), "dense").when((d < 300) | (hcr > 0.2), "complex").otherwise("open")


def tower_guides(rules: DataFrame) -> DataFrame:
    """Rules with the values that their cost polygons burn into the passage and the tower grid, null for none."""
    land, cross = F.coalesce("land_num", F.lit(0.0)), cost.base_cross_cost()
    price = F.greatest(land, F.when(cross < FORBIDDEN, cross).otherwise(0.0))
    return rules.withColumn("guide", F.when(cost.one_time(), cost.guide_value(price))).withColumn("tower_guide", F.when(land > 0, cost.tower_guide(land)))
