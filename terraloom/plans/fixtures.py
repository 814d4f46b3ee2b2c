"""Deterministic geometry views over the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from terraloom.rules import values_sql

SUFFIXES = ["", "_保护范围", "_奖励范围", "_缓冲范围", "_河道范围"]
FOLDERS = [
    "441402梅江区/城镇开发边界", "441402梅江区/441402/永久基本农田", "河流敏感点/通航河流", "data/非通航河流2021", "交通敏感点", "vectors",
    "生态敏感点/森林公园/备份", "441403梅县区/生态保护红线陆域", "电力设施敏感点/既有线路", "地形/DEM", "440000/军事设施_新", "密集通道/西线",
]
_NAMES = "(SELECT row_number() OVER (ORDER BY src, pos) - 1 AS k, nm FROM (SELECT 0 AS src, rule_id AS pos, level2 AS nm FROM rules UNION ALL SELECT 1 AS src, position AS pos, phrase AS nm FROM lookups WHERE kind = 'alias' UNION ALL SELECT 2 AS src, 0 AS pos, '无名图层' AS nm) a)"


def _list(column: str, items: list[str]) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(items))}) AS t(k, {column}))"


VIEWS = {
    "rules": values_sql("rules"),
    "lookups": values_sql("lookups"),
    "zones": "SELECT * FROM (VALUES (1, 'A', 0, CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE), 90, 0), (2, 'B', 10, CAST(1.15 AS DOUBLE), CAST(1.1 AS DOUBLE), 90, 50), (3, 'C', 20, CAST(1.4 AS DOUBLE), CAST(1.25 AS DOUBLE), 45, 200), (4, 'D', 30, CAST(1.65 AS DOUBLE), CAST(1.4 AS DOUBLE), 45, 500)) AS t(zone_code, wind_zone, ice_zone, tower_mult, line_mult, max_turn, adder)",
    "poly": """SELECT fid, rule_id, variant, x0 AS xmin, y0 AS ymin, x0 + w AS xmax, y0 + h AS ymax FROM (
        SELECT p_partkey AS fid, CAST(p_partkey % 65 + 1 AS INT) AS rule_id, CASE p_partkey % 5 WHEN 0 THEN 'protection' WHEN 1 THEN 'reward' ELSE 'primary' END AS variant,
        CAST((p_partkey * 37) % 400 AS DOUBLE) * 50 AS x0, CAST((p_partkey * 91) % 400 AS DOUBLE) * 50 AS y0, CAST(p_size AS DOUBLE) * 40 AS w, CAST(p_size % 9 + 1 AS DOUBLE) * 25 AS h FROM part) t""",
    "line": """SELECT o_orderkey AS fid, CAST(o_orderkey % 33 + 33 AS INT) AS rule_id, CAST((o_orderkey * 53) % 400 AS DOUBLE) * 50 AS x1, CAST((o_orderkey * 29) % 400 AS DOUBLE) * 50 AS y1,
        CAST(o_orderkey % 7 AS DOUBLE) * 30 AS dx1, CAST(o_orderkey % 5 + 1 AS DOUBLE) * 40 AS dy1, CAST(o_orderkey % 3 + 1 AS DOUBLE) * 60 AS dx2, CAST(o_orderkey % 4 AS DOUBLE) * 20 AS dy2 FROM orders""",
    "point": "SELECT c_custkey AS fid, CAST((c_custkey * 71) % 20000 AS DOUBLE) + 5e-1 AS x, CAST((c_custkey * 113) % 20000 AS DOUBLE) + 5e-1 AS y, CAST(c_custkey % 65 + 1 AS INT) AS rule_id FROM customer",
    "grid": """SELECT r, c, CASE WHEN (r * 31 + c * 17) % 97 = 0 THEN NULL ELSE 300 + 80 * sin(r / 9e0) + 60 * cos(c / 7e0) END AS elev, (CAST(floor(r / 25e0) AS INT) + CAST(floor(c / 25e0) AS INT)) % 6 AS zone_code
        FROM (SELECT a.n_nationkey * 5 + b.r_regionkey AS r FROM nation a CROSS JOIN region b) x CROSS JOIN (SELECT a.n_nationkey * 5 + b.r_regionkey AS c FROM nation a CROSS JOIN region b) y""",
    "layer": f"SELECT p.p_partkey AS fid, n.nm || s.sfx AS layer, f.folder AS folder, CASE p.p_partkey % 3 WHEN 0 THEN '河流敏感点' WHEN 1 THEN '未知数据集' END AS dataset FROM part p JOIN {_NAMES} n ON n.k = p.p_partkey % 79 JOIN {_list('sfx', SUFFIXES)} s ON s.k = p.p_partkey % 5 JOIN {_list('folder', FOLDERS)} f ON f.k = p.p_partkey % 12",
    "ctrl": "SELECT * FROM (VALUES ('start_end', 1, 'start', CAST(1000 AS DOUBLE), CAST(1000 AS DOUBLE)), ('start_end', 2, '终点', CAST(18000 AS DOUBLE), CAST(15000 AS DOUBLE)), ('must_pass', 1, 'p', CAST(6000 AS DOUBLE), CAST(7000 AS DOUBLE)), ('must_pass', 2, 'q', CAST(12000 AS DOUBLE), CAST(9000 AS DOUBLE)), ('dense_corridor', 1, 'd', CAST(9000 AS DOUBLE), CAST(11000 AS DOUBLE))) AS t(ctrl_kind, seq, type, x, y)",
}
_TABLES = {"poly": ["part"], "line": ["orders"], "point": ["customer"], "grid": ["nation", "region"], "layer": ["part"]}
_NEEDS = {"layer": ["rules", "lookups"]}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """sql with the named views in front, prefixed v_ but for the rule tables."""
    names: list[str] = []
    for v in views:
        names += [x for x in (*_NEEDS.get(v, []), v) if x not in names]
    if not names:
        return sql
    heads = ", ".join(f"{view_name(v)} AS ({VIEWS[v]})" for v in names)
    if sql[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads}, {sql[15:]}"
    return f"WITH {heads}{', ' + sql[5:] if sql[:5].upper() == 'WITH ' else ' ' + sql}"


def view_name(v: str) -> str:
    return v if v in ("rules", "lookups", "zones") else f"v_{v}"


class Context:
    """The views of one dataset as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """Resolved against the files directly: no temporary view is registered."""
        sql = with_views(f"SELECT * FROM {view_name(name)}", (name,))
        frames = {t: self.table(t) for t in _TABLES.get(name, [])}
        for t in frames:
            sql = _replace_table(sql, t)
        return self.spark.sql(sql, **frames)

    rules = cached_property(lambda self: self.view("rules"))
    zones = cached_property(lambda self: self.view("zones"))
    poly = cached_property(lambda self: self.view("poly"))
    line = cached_property(lambda self: self.view("line"))
    point = cached_property(lambda self: self.view("point"))
    grid = cached_property(lambda self: self.view("grid"))
    layer = cached_property(lambda self: self.view("layer"))
    ctrl = cached_property(lambda self: self.view("ctrl"))


def _replace_table(sql: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)
