"""Circles through stations of rivers, from sums alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_circle(points: DataFrame) -> DataFrame:
    """Least-squares circle (Kasa) of the points (fid, x, y) by fid, from sums alone."""
    m = points.groupBy("fid").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    s = points.join(m, "fid").withColumns({"u": u, "v": v}).groupBy("fid", "mx", "my").agg(*[F.sum(e).alias(n) for n, e in {"uu": F.col("u") ** 2, "vv": F.col("v") ** 2, "uv": F.col("u") * F.col("v"), "p": F.col("u") ** 3 + F.col("u") * F.col("v") ** 2, "q": F.col("v") ** 3 + F.col("v") * F.col("u") ** 2}.items()], F.count("*").alias("n"))
    det = F.nullif(F.round(F.col("uu") * F.col("vv") - F.col("uv") ** 2, 9), F.lit(0.0))
    a, b = (F.col("p") * F.col("vv") - F.col("q") * F.col("uv")) / (2 * det), (F.col("q") * F.col("uu") - F.col("p") * F.col("uv")) / (2 * det)
    return s.select("fid", (F.col("mx") + a).alias("cx"), (F.col("my") + b).alias("cy"), F.sqrt(a**2 + b**2 + (F.col("uu") + F.col("vv")) / F.col("n")).alias("radius"))
