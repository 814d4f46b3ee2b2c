"""The library without the text operators: golden values and queries against DuckDB."""

import duckdb
import pytest

from terraloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = ["rules_scan", "land_cost", "base_cross_cost", "cost_decompose", "geometry_family", "rule_behavior", "rule_compile", "route_primary", "route_protection", "sink_totals", "join_rule_fallback", "layer_parse", "path_category", "fuzzy_tiers", "segment_lines", "linear_cross", "smooth_line", "split_zigzag", "validate_crs", "eco_overlap", "range_self_join", "pip_semi_join", "rasterize_max", "lpcf", "slope", "tpi", "edt", "skeleton_edges", "connected_components", "parallel_runs", "delivery_level", "verify_manifest"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 5) + 0.0


@pytest.mark.parametrize("name", CHECKED)
def test_matches_oracle(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    got = sorted(str([_plain(v) for v in r]) for r in df.select(names).collect())
    assert got == sorted(str([_plain(r[i]) for i in at]) for r in want.fetchall())


def test_golden_costs(spark):
    rows = {(r.rule_id, r.angle, r.length_km): r.cost for r in QUERIES["cross_cost_eval"](spark, SF).collect()}
    assert rows[35, 60.0, 2.5] == 450 and rows[4, 60.0, 2.5] == 4250 and rows[2, 60.0, 2.5] == 999999
    sums = QUERIES["cost_decompose"](spark, SF).groupBy().sum().first().asDict()
    assert [sums[f"sum({k})"] for k in ("cross_cost", "cross_cost_angle_coeff", "cross_cost_per_km", "tower_cost")] == [52153, 290, 500, 13900]
    assert sum(r.one_time for r in QUERIES["one_time_cost"](spark, SF).collect()) == 41
    assert sum(r.range_out for r in QUERIES["parallel_range"](spark, SF).collect()) == 2600


def test_golden_names(spark):
    from terraloom.operators.classify import match_names

    names = ["省道", "自然保护区 核心区", "35 kV 架空线", "±500 kV直流", "10kV线路", "高速公路网", "通航河道", "变电所", "水库"]
    got = {r.n: (r.m.level2, round(r.m.score, 4)) for r in match_names(spark.createDataFrame([(x,) for x in names], "n string"), "n", "m").collect()}
    want = [("省道", 1.0), ("自然保护区核心区", 0.95), ("35kV输电线路", 0.9), ("±500kV输电线路", 0.9), ("110kV输电线路", 0.9), ("高速公路", 0.8889), ("通航河流", 0.75), ("变电站", 0.6667), ("炸药库", 0.4)]
    assert [got[n] for n in names] == want


def test_golden_segments(spark):
    from terraloom.operators.lines import segment

    line = spark.sql("SELECT 1 AS fid, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 0D, 'y', 70D), named_struct('x', 50D, 'y', 70D)) AS coords")
    got = [(r.x2, r.y2, round(r.azimuth_deg, 2)) for r in segment(line).orderBy("i").collect()]
    assert got == [(0.0, 50.0, 0.0), (30.0, 70.0, 56.31), (50.0, 70.0, 90.0)]


def test_projection_round_trip():
    import numpy as np

    from terraloom.functions.crs import project, unproject

    lon, lat, cm = np.array([116.41, 113.0, 75.5]), np.array([24.35, 40.0, 10.0]), np.array([117.0, 114.0, 75.0])
    back = unproject(*project(lon, lat, cm), cm)
    assert np.allclose(back, (lon, lat), atol=1e-9)
