"""Rule joins and routing of polygons into the forbidden (F), no-tower (N) and cost (C) sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions import cost
from terraloom.rules import FORBIDDEN


def with_rule(features: DataFrame, rules: DataFrame, by_id: str = "std_rule_id", by_name: str = "std_level2") -> DataFrame:
    """Each feature with its rule as struct `rule`: by id, else by level2; features without one go. Rules are 65 rows."""
    packed = rules.select("rule_id", "level2", F.struct(*rules.columns).alias("r"))
    a, b = F.broadcast(packed.select(F.col("rule_id").alias("_i"), F.col("r").alias("_ri"))), F.broadcast(packed.select(F.col("level2").alias("_n"), F.col("r").alias("_rn")))
    joined = features.join(a, F.col(by_id) == F.col("_i"), "left").join(b, F.col(by_name) == F.col("_n"), "left")
    return joined.withColumn("rule", F.coalesce("_ri", "_rn")).filter("rule IS NOT NULL").drop("_i", "_ri", "_n", "_rn")


def safe_level2(given: Column, of_rule: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), of_rule)


def normal_variant(variant: Column) -> Column:
    return F.when(variant.isin("primary", "protection", "reward"), variant).otherwise("primary")


def sinks(variant: Column) -> Column:
    """Array of sinks for a polygon, over the columns of the rule table; reward polygons go to none here."""
    land, base = cost.land_cost(), cost.base_cross_cost()
    lc, cc = F.when(land < FORBIDDEN, land).otherwise(0.0), F.when(base < FORBIDDEN, base).otherwise(0.0)
    no_tower = ~F.col("land") | (land >= FORBIDDEN)
    closed = ~F.col("enter") & ~F.col("may_cross")
    mark = lambda test, name: F.when(test, F.lit(name))
    primary = F.when(closed, F.array(F.lit("F"))).otherwise(F.array_compact(F.array(mark(no_tower, "N"), mark((lc > 0) | (cc > 0), "C"))))
    protection = F.array_compact(F.array(mark(~F.col("may_cross") | (base >= FORBIDDEN), "F"), mark(no_tower, "N"), mark((lc > 0) | (cc > 0) | cost.has_formula(), "C")))
    return F.when(variant == "protection", protection).when(variant == "primary", primary).otherwise(F.array().cast("array<string>"))


def route(polygons: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per polygon and sink, with area and, for the cost sink, its costs. Inner join on rule_id."""
    land, base = cost.land_cost(), cost.base_cross_cost()
    joined = polygons.join(F.broadcast(rules), "rule_id")
    priced = joined.withColumn("lc", F.when(land < FORBIDDEN, land).otherwise(0.0)).withColumn("cc", F.when(base < FORBIDDEN, base).otherwise(0.0))
    return priced.withColumn("variant", normal_variant(F.col("variant"))).withColumn("sink", F.explode(sinks(F.col("variant"))))
