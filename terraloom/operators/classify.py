"""Matching free names to feature classes, from exact to similar."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.ingest import look_up, phrase_array, phrase_rows
from terraloom.rules import rows

LEVEL1_FIELDS = "一级分类 LV1_CLASS level1 一级类别 LEVEL1".split()
LEVEL2_FIELDS = "二级分类 LV2_CLASS level2 二级类别 LEVEL2 name NAME 类型 type category TYPE".split()
AUTO, REVIEW = 0.85, 0.6
NAMES = ("path_level1", "path_level2", "path_canonical", "theme", "raw_level1", "raw_level2", "layer")
_MATCH = "struct<level1: string, level2: string, score: double>"
_NARROW = str.maketrans("（）－", "()-", " \t")
_VOLTAGE = re.compile(r"[±]?\d+\s*[kK][vV]")


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.trim(text, F.lit(" \t\r\n"))), "（）－", "()-"), "[ \t]", "")


def discover(attrs: Column, names: list[str]) -> Column:
    """The first attribute of a list that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(attrs[n]), F.lit("")) for n in names], F.lit(""))


def sure_match(name: Column) -> Column:
    """Equal, equal when normalised, or of the same voltage: struct or null. The voltage tier matches substrings, so 10kV hits 110kV."""
    table = phrase_array("normal")
    first = lambda test: F.get(F.filter(table, test), F.lit(0))
    volts = F.lower(F.regexp_replace(F.regexp_extract(name, r"[±]?\d+\s*[kK][vV]", 0), " ", ""))
    exact, alike = first(lambda x: x["phrase"] == name), first(lambda x: normal_text(x["phrase"]) == normal_text(name))
    same = F.when(volts != "", first(lambda x: F.lower(F.regexp_replace(x["phrase"], " ", "")).contains(volts)))
    make = lambda m, s: F.struct(m["level1"].alias("level1"), m["level2"].alias("level2"), F.lit(s).alias("score"))
    return F.when(exact.isNotNull(), make(exact, 1.0)).when(alike.isNotNull(), make(alike, 0.95)).when(same.isNotNull(), make(same, 0.9))


@lru_cache(1 << 16)
def most_similar(name: str) -> tuple[str, str, float]:
    """(level1, level2, ratio) of the phrase with the highest Ratcliff-Obershelp ratio, the first of equals."""
    best = ("", "", 0.0)
    for _, phrase, level1, level2 in phrase_rows("normal"):
        score = SequenceMatcher(None, name, phrase).ratio()
        if score > best[2]:
            best = (level1, level2, score)
    return best


@lru_cache(1 << 16)
def best_match(name: str) -> tuple[str, str, float]:
    """(level1, level2, score): equal, equal when normalised, of the same voltage, or the most similar."""
    table = phrase_rows("normal")
    plain = lambda text: text.strip(" \t\r\n").lower().translate(_NARROW)
    volts = _VOLTAGE.search(name)
    volts = volts.group().lower().replace(" ", "") if volts else ""
    for score, test in ((1.0, lambda p: p == name), (0.95, lambda p: plain(p) == plain(name)), (0.9, lambda p: volts and volts in p.lower().replace(" ", ""))):
        for _, phrase, level1, level2 in table:
            if test(phrase):
                return level1, level2, score
    return most_similar(name)


def _matches(names: pa.Array) -> pa.Array:
    """best_match of each name, worked out once per distinct one."""
    coded = names.dictionary_encode()
    found = pa.array([dict(zip(("level1", "level2", "score"), best_match(x) if x else ("", "", 0.0), strict=True)) for x in coded.dictionary.to_pylist()], pa.struct([("level1", pa.string()), ("level2", pa.string()), ("score", pa.float64())]))
    return found.take(coded.indices)


def match_names(features: DataFrame, column: str, out: str) -> DataFrame:
    """features with struct `out` for the names in `column`, null where there is none. Nothing is joined or shuffled: tasks keep the names they have met."""
    matched = F.arrow_udf(_matches, _MATCH)(column)
    return features.withColumn(out, F.when(F.col(column) != "", matched))


def assign_rule(level2: Column, canonical: Column) -> Column:
    ids = {r[1]: r[0] for r in rows("rules")[1]}
    return F.coalesce(look_up(level2, ids), look_up(F.nullif(F.trim(canonical), F.lit("")), ids), F.lit("-1")).cast("int")


def decide(path_level1: str, path_level2: str, path_canonical: str, theme: str, raw_level1: str, raw_level2: str, layer: str) -> tuple[str, str, str, float]:
    """(level1, level2, method, confidence) by eleven methods in order, each tried only where those before it fail."""
    known, themes = _known()
    if path_canonical in known:
        return path_level1, path_level2 or path_canonical, "path_deterministic", 1.0
    if path_canonical:
        a, b, score = best_match(path_canonical)
        if score >= AUTO:
            return a, path_level2 or b, "path_fuzzy_auto", score
    if theme in themes:
        return *themes[theme], "deterministic_theme", 1.0
    if raw_level2:
        a, b, score = best_match(raw_level2)
        by = "path_l1_field_l2" if path_level1 and not path_level2 else "fuzzy"
        if score >= REVIEW:
            return a, b, f"{by}_{'auto' if score >= AUTO else 'review'}", score
    if layer:
        a, b, score = most_similar(layer)
        if score >= REVIEW:
            return a, b, f"layer_name_{'auto' if score >= AUTO else 'review'}", score
    if path_level1:
        return path_level1, "UNKNOWN", "path_l1_only", 0.5
    return "UNKNOWN", "UNKNOWN", "unmapped", 0.0


@cache
def _known() -> tuple[set[str], dict[str, tuple[str, str]]]:
    return {r[1] for r in rows("rules")[1]}, {w: (a, b) for _, w, a, b in phrase_rows("theme")}


def _decisions(*columns: pa.Array) -> pa.Array:
    """decide() of each row, worked out once per distinct row of names."""
    coded = [c.dictionary_encode() for c in columns]
    key = np.zeros(len(columns[0]), np.int64)
    for c in coded:
        key = np.unique(key * (len(c.dictionary) + 1) + c.indices.to_numpy(), return_inverse=True)[1]
    _, at, inv = np.unique(key, return_index=True, return_inverse=True)
    found = [decide(*row) for row in zip(*(c.take(pa.array(at)).to_pylist() for c in columns), strict=True)]
    kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
    return pa.StructArray.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=["a", "b", "how", "score"]).take(pa.array(inv))


def classify(features: DataFrame) -> DataFrame:
    """path_level1, path_level2, path_canonical, theme, raw_level1, raw_level2, layer -> std_level1, std_level2, std_rule_id, mapping_method, mapping_confidence.

    One pass without joins; names are trimmed, null counts as blank.
    """
    clean = {c: F.trim(F.coalesce(c, F.lit(""))) for c in NAMES}
    clean["path_canonical"] = F.coalesce(F.nullif(clean["path_canonical"], F.lit("")), clean["path_level2"])
    choice = F.arrow_udf(_decisions, "struct<a: string, b: string, how: string, score: double>").asNondeterministic()(*[clean[c] for c in NAMES])
    done = features.withColumns(clean).withColumn("_c", choice)
    done = done.withColumns({"std_level1": F.col("_c.a"), "std_level2": F.col("_c.b"), "mapping_method": F.col("_c.how"), "mapping_confidence": F.col("_c.score")}).drop("_c")
    return done.withColumn("std_rule_id", assign_rule(F.col("std_level2"), F.col("path_canonical")))


def review_candidates(classified: DataFrame) -> DataFrame:
    """What people have to look at, once per (raw names, layer): the first feature stands for all."""
    open_ = classified.filter("mapping_method LIKE '%review' OR mapping_method IN ('path_l1_only', 'unmapped')")
    return open_.groupBy("raw_level1", "raw_level2", "layer").agg(F.min("fid").alias("fid"))
