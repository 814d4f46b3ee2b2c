"""Names, folders and layers: what a dataset is, read off where it lies and what it is called."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.rules import rows

SUFFIX = r"^(.+?)(_(?:保护|奖励|缓冲|河道)范围)?$"


@cache
def phrase_rows(kind: str) -> list[tuple[int, str, str, str]]:
    """(position, phrase, level1, level2) in order; level2 is empty where a phrase names a level1 only."""
    names = {r[0]: (r[2], r[1]) for r in rows("rules")[1]}
    return [(int(p), phrase, *names.get(means, (means, ""))) for k, p, phrase, means in rows("lookups")[1] if k == kind]


def phrase_array(kind: str) -> Column:
    """The phrase table as an array literal, for look-ups within generated code."""
    text = ", ".join(f"struct({p} AS position, '{w}' AS phrase, '{a}' AS level1, '{b}' AS level2)" for p, w, a, b in phrase_rows(kind))
    return F.expr(f"array({text})")


def look_up(key: Column, pairs: dict[str, str]) -> Column:
    """pairs[key], null where there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key)


def alias_of(base: Column) -> Column:
    return F.coalesce(look_up(base, {w: b for _, w, _, b in phrase_rows("alias")}), base)


def layer_base(layer: Column) -> Column:
    return F.regexp_extract(layer, SUFFIX, 1)


def layer_variant(layer: Column) -> Column:
    tail = F.regexp_extract(layer, SUFFIX, 2)
    return F.when(tail == "_奖励范围", "reward").when(tail != "", "protection").otherwise("primary")


def folder_match(path: Column) -> tuple[Column, Column]:
    """(level1, level2) from the chain of folders: exact names before contained ones, inner folders before outer, first of the table."""
    parts = F.filter(F.reverse(F.split(path, "/")), lambda p: ~p.rlike(r"(\.gdb|\.shp)$|^\d+$") & (p != ""))
    table = phrase_array("folder")

    def match(part: Column) -> Column:
        return F.coalesce(F.get(F.filter(table, lambda x: x["phrase"] == part), F.lit(0)), F.get(F.filter(table, lambda x: part.contains(x["phrase"])), F.lit(0)))

    hits = F.filter(F.transform(parts, match), lambda m: m.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0))["level1"], F.lit("")), F.coalesce(F.get(F.filter(hits, lambda m: m["level2"] != ""), F.lit(0))["level2"], F.lit(""))


def parse_layers(layers: DataFrame) -> DataFrame:
    """layer, folder, dataset -> base_level2, canonical_level2, variant, level1, resolution_path."""
    base = layers.withColumn("base_level2", layer_base(F.col("layer"))).withColumn("variant", layer_variant(F.col("layer"))).withColumn("canonical_level2", alias_of(F.col("base_level2")))
    by_rule = look_up(F.col("canonical_level2"), {r[1]: r[2] for r in rows("rules")[1]})
    by_dataset = look_up(F.col("dataset"), {w: a for _, w, a, _ in phrase_rows("dataset")})
    by_folder = F.nullif(folder_match(F.col("folder"))[0], F.lit(""))
    how = F.when(by_rule.isNotNull(), "rule_table_lookup").when(by_dataset.isNotNull(), "feature_dataset_probe").when(by_folder.isNotNull(), "path_inference").otherwise("unresolved")
    return base.withColumn("level1", F.coalesce(by_rule, by_dataset, by_folder, F.lit(""))).withColumn("resolution_path", how)


def raster_type(path: Column) -> Column:
    low = F.lower(path)
    has = lambda c, *words: F.expr("false") if not words else _any(c, words)
    return (
        F.when(has(low, "dem", "dsm"), "DEM").when(has(low, "dom"), "DOM").when(has(low, "wind", "ice"), "WIND_ICE_ZONE").when(has(low, "landuse", "land_use"), "LANDUSE")
        .when(has(path, "数字高程", "高程", "地形"), "DEM").when(has(path, "数字表面", "地表模型"), "DSM").when(has(path, "风冰", "风区", "覆冰"), "WIND_ICE_ZONE").when(has(path, "土地利用", "用地分类", "地类"), "LANDUSE")
        .otherwise("UNKNOWN_RASTER")
    )


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = c.contains(words[0])
    for w in words[1:]:
        out = out | c.contains(w)
    return out


def district_code(path: Column) -> Column:
    """Six digits: of the parent folder first, then anywhere."""
    parent = F.coalesce(F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2), F.lit(""))
    return F.coalesce(F.nullif(F.regexp_extract(parent, r"(\d{6})", 1), F.lit("")), F.regexp_extract(path, r"(\d{6})", 1))


def district_name(path: Column) -> Column:
    return F.regexp_extract(path, "\\d{6}([一-龥]+[区县市])", 1)


def variant_inventory(parsed: DataFrame) -> DataFrame:
    """Counts of the variants by base name; a canonical name also lists the names that were folded into it."""
    counts = parsed.groupBy("base_level2").agg(*[F.count_if(F.col("variant") == v).alias(v) for v in ("primary", "protection", "reward")], F.first("canonical_level2").alias("canonical")).withColumnRenamed("base_level2", "name")
    folded = parsed.filter("base_level2 <> canonical_level2").groupBy(F.col("canonical_level2").alias("name")).agg(F.array_sort(F.collect_set("base_level2")).alias("alias_from"))
    both = counts.join(folded, "name", "full")
    none = F.array().cast("array<string>")
    return both.select("name", *[F.coalesce(v, F.lit(0)).alias(v) for v in ("primary", "protection", "reward")], F.coalesce("canonical", "name").alias("canonical"), F.coalesce("alias_from", none).alias("alias_from"))


def protection_coverage(inventory: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that ask for a buffer without a protection layer under their name or one folded into it."""
    have = inventory.filter("protection > 0")
    names = have.select("name").union(have.select("canonical")).distinct().toDF("level2")
    return rules.filter("buffer_m > 0").join(names, "level2", "left_anti").select("rule_id", "level1", "level2", "buffer_m")
