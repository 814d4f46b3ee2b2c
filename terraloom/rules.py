"""The rule table and the phrase tables, as inline relations that both Spark and other SQL engines read."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DATA = Path(__file__).parent / "data"
FORBIDDEN = 999999.0
_INT = {"rule_id", "range_m", "position"}
_TEXT = {"level1", "level2", "cost_type", "land_text", "cross_text", "kind", "phrase", "means"}
_FLAG = {"enter", "land", "may_cross", "river_width", "client_range"}


@cache
def rows(name: str) -> tuple[list[str], list[list[str]]]:
    lines = (DATA / f"{name}.tsv").read_text(encoding="utf-8").splitlines()
    head = lines[0].split("\t")
    return head, [(line + "\t" * len(head)).split("\t")[: len(head)] for line in lines[1:]]


def _literal(column: str, text: str) -> str:
    kind = "INT" if column in _INT else "STRING" if column in _TEXT else "BOOLEAN" if column in _FLAG else "DOUBLE"
    if text == "":
        return f"CAST(NULL AS {kind})"
    if kind == "STRING":
        return "'" + text.replace("'", "''") + "'"
    return {"INT": text, "BOOLEAN": "true" if text in ("1", "True") else "false", "DOUBLE": f"CAST({text} AS DOUBLE)"}[kind]


@cache
def values_sql(name: str) -> str:
    """The table as SELECT ... FROM VALUES, in SQL that Spark and DuckDB share."""
    head, body = rows(name)
    tuples = ",\n".join("(" + ", ".join(_literal(c, x) for c, x in zip(head, r, strict=True)) + ")" for r in body)
    return f"SELECT * FROM (VALUES {tuples}) AS t({', '.join(head)})"


def rules(spark: SparkSession) -> DataFrame:
    """65 rules; costs split into number and text, formula into base, k_angle and k_km."""
    return spark.sql(values_sql("rules"))


def phrases(spark: SparkSession, kind: str) -> DataFrame:
    """(position, phrase, means) of one phrase table; means is a rule id or, for folders and datasets, a level1."""
    return spark.sql(values_sql("lookups")).filter(f"kind = '{kind}'").drop("kind")
