"""How far a path runs along another line: stations, islands of qualifying stations, rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.operators import paths

STATION_M = 50.0


def stations(pairs: DataFrame, path: str = "path", line: str = "line", length: float = STATION_M) -> DataFrame:
    """A row per station of `path`: where it starts and ends, its distance to `line` and the angle between the two. Nothing is shuffled."""
    measured = F.arrow_udf(paths.stations(length), paths.STATION)
    keys = [F.col(f"`{c}`") for c in pairs.columns if c not in (path, line)]
    return pairs.select(*keys, F.explode(measured(path, line)).alias("_s")).select(*keys, "_s.*")


def runs(stations_: DataFrame, keys: list[str], distance_m: float, angle_deg: float, least_m: float) -> DataFrame:
    """Islands of neighbouring stations that are near and parallel enough, of a least length. Paths shorter than that have none."""
    ok = stations_.filter((F.col("path_m") >= least_m) & (F.col("distance") <= distance_m) & (F.col("angle") <= angle_deg))
    island = F.col("k") - F.row_number().over(W.partitionBy(*keys).orderBy("k"))
    g = ok.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("s").alias("start_m"), F.max("e").alias("end_m"))
    return g.drop("_i").withColumn("length_m", F.col("end_m") - F.col("start_m")).filter(F.col("length_m") >= least_m)


def reward(runs_: DataFrame, keys: list[str], per_1000m: float) -> DataFrame:
    return runs_.groupBy(*keys).agg((F.sum("length_m") / 1000 * per_1000m).alias("reward"))
