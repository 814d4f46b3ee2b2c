"""Project settings: defaults, project.json, command line, in this order; a later one wins."""

from __future__ import annotations

import json
from pathlib import Path

DEFAULTS = {
    "project_name": "unnamed", "voltage_kv": 500, "ice_zone": 10, "wind_zone": "B", "source_crs": "EPSG:4490", "working_crs": "EPSG:4547",
    "data_availability": {"river_polygon": False, "wind_ice_zone_raster": False}, "resolution_m": 100.0,
    "flags": {"emit_unconsumed_outputs": False, "emit_fine": False, "enable_airport_legacy_processing": False, "enable_building_cluster_legacy": False, "enable_corridor_legacy": False, "allow_planar_2d_mode": False, "disable_river": False, "disable_wind_ice": False},
    "building_cluster": {"buffer_m": 100, "merge_gap_m": 50, "min_cluster_area_m2": 50000, "dense_zone_penalty": 3000},
    "solver_params": {"nav_graph_mode": "deferred", "skeleton_budget_nodes": 12000, "skeleton_edge_candidate_budget": 600000, "skeleton_cutoff_nn_factor": 4.0, "skeleton_cutoff_min_m": 500.0, "skeleton_cutoff_max_m": 1500.0},
}


def merged(*layers: dict | None) -> dict:
    """Later layers win key by key, also inside nested ones; None leaves what was there."""
    out: dict = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = merged(out[k], v)
            elif v is not None:
                out[k] = merged(v) if isinstance(v, dict) else v
    return out


def load(project_dir: str | Path, overrides: dict | None = None, file: str | Path | None = None) -> dict:
    """Settings of a project folder; without a project.json the defaults, which `has_file` tells. Top-level switches count as flags."""
    path = Path(file) if file else Path(project_dir) / "project.json"
    own = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    flags = {k: own[k] for k in DEFAULTS["flags"] if k in own}
    return merged(DEFAULTS, {k: v for k, v in own.items() if k not in flags}, {"flags": flags}, overrides, {"has_file": path.exists()})


def srs(settings: dict) -> int:
    """EPSG code of the working system."""
    digits = "".join(ch for ch in str(settings["working_crs"]) if ch.isdigit())
    return int(digits) if digits else 0
