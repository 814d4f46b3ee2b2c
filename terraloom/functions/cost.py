"""Cost arithmetic of rules, as columns over the rule table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.rules import FORBIDDEN

_FORMULA = ("angle_formula", "length_formula")
_BAN = "禁止"


def _c(name: str) -> Column:
    return F.col(name)


def _fixed(number: str, text: str) -> Column:
    return F.when(_c(number).isNotNull(), _c(number)).when(_c(text).contains(_BAN), FORBIDDEN).otherwise(0.0)


def has_formula() -> Column:
    return _c("base").isNotNull()


def cross_cost(angle_deg: Column, length_km: Column) -> Column:
    """Cost of a crossing at an angle, over a length."""
    bend = F.cos(F.radians(F.greatest(F.lit(0.0), F.least(F.lit(90.0), angle_deg))))
    return (
        F.when(_c("cost_type") == "forbidden", FORBIDDEN)
        .when((_c("cost_type") == "angle_formula") & has_formula(), _c("base") + F.coalesce("k_angle", F.lit(0.0)) * bend)
        .when((_c("cost_type") == "length_formula") & has_formula(), _c("base") + F.coalesce("k_km", F.lit(0.0)) * length_km)
        .otherwise(_fixed("cross_num", "cross_text"))
    )


def base_cross_cost() -> Column:
    """The part of the crossing cost that depends on neither angle nor length."""
    return F.when(_c("cost_type") == "forbidden", FORBIDDEN).when(_c("cost_type").isin(*_FORMULA) & has_formula(), _c("base")).otherwise(_fixed("cross_num", "cross_text"))


def land_cost() -> Column:
    return _fixed("land_num", "land_text")


def one_time() -> Column:
    """Whether the cost falls due per event instead of along the way."""
    return F.when(_c("cost_type") == "forbidden", False).when(_c("cost_type").isin(*_FORMULA), True).otherwise((F.coalesce("cross_num", F.lit(0.0)) > 0) | (F.coalesce("land_num", F.lit(0.0)) > 0))


def parallel_range() -> Column:
    return F.when(_c("range_m") > 0, _c("range_m")).when(F.coalesce("reward", F.lit(0.0)) != 0, 200).otherwise(0)


def numeric_parts() -> dict[str, Column]:
    """Costs as plain numbers; bans are 0 here because flags carry them."""
    base = F.when(_c("cost_type").isin(*_FORMULA), _c("base")).otherwise(_c("cross_num"))
    zero = F.lit(0.0)
    return {"cross_cost": F.coalesce(base, zero), "cross_cost_angle_coeff": F.coalesce("k_angle", zero), "cross_cost_per_km": F.coalesce("k_km", zero), "tower_cost": F.coalesce("land_num", zero)}


def geometry_family() -> Column:
    areal = _c("level2").isin(*"机场 换流站 接地极 变电站".split())
    spots = _c("level2").isin(*"矿产资源 采石场 军事敏感点 无线电设施 导航台 炸药库 油气存储站 地震地磁台 气象站".split())
    return (
        F.when(_c("level1").isin("交通敏感点", "电力设施敏感点", "管廊敏感点"), F.when(areal, "polygon").otherwise("line"))
        .when(_c("level1") == "河流", "line")
        .when(_c("level1") == "地形", "raster")
        .when((_c("buffer_m") > 0) & (_c("level1") == "重要设施与政府规划敏感点") & spots, "point")
        .otherwise("polygon")
    )


def behavior() -> Column:
    angled = F.coalesce("min_angle", F.lit(0.0)) != 0
    priced = (F.coalesce("land_num", F.lit(0.0)) > 0) | (F.coalesce("cross_num", F.lit(0.0)) > 0)
    return (
        F.when(~_c("enter") & ~_c("may_cross"), "FORBIDDEN_AREA")
        .when(angled, "LINEAR_CROSS_CONTROL")
        .when(~_c("land"), "NO_TOWER_AREA")
        .when(F.coalesce("reward", F.lit(0.0)) != 0, "PREFERRED_CORRIDOR")
        .when(_c("cost_type").isin(*_FORMULA) | priced, "HIGH_COST_AREA")
        .otherwise("NORMAL")
    )


def voltage_kv(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(?i)(\d+)\s*kV", 1), F.lit("")).try_cast("int"), F.lit(0))


def guide_value(cost: Column) -> Column:
    return F.when(cost >= 5000, 8.0).when(cost >= 1000, 4.0).when(cost >= 100, 2.0).otherwise(1.5)


def tower_guide(cost: Column) -> Column:
    return F.least(cost * 0.01, F.lit(10.0))
