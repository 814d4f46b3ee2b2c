"""Files of the delivery package: JSON, GeoPackage and GeoTIFF, written by the driver from rows that stream to it.

Large results stay in Parquet tables; these files are what other programs read.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

_KINDS = {"point": 1, "line": 2, "polygon": 3}


class _Plain(json.JSONEncoder):
    def default(self, o):
        if isinstance(o, np.generic):
            return o.item()
        return o.tolist() if isinstance(o, np.ndarray) else str(o)


def save_json(data, path: str | Path) -> Path:
    """UTF-8, two spaces; numpy values as plain ones."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, ensure_ascii=False, indent=2, cls=_Plain), encoding="utf-8")
    return path


def wkb(kind: str, parts: list[list[tuple[float, float]]]) -> bytes:
    """Well-known binary of a point, of lines or of rings; several lines are a multi-line, rings are one polygon."""
    flat = lambda points: struct.pack("<I", len(points)) + struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p])
    if kind == "point":
        return struct.pack("<BI2d", 1, 1, *parts[0][0])
    if kind == "line" and len(parts) == 1:
        return struct.pack("<BI", 1, 2) + flat(parts[0])
    if kind == "line":
        return struct.pack("<BII", 1, 5, len(parts)) + b"".join(struct.pack("<BI", 1, 2) + flat(p) for p in parts)
    closed = [p if p[0] == p[-1] else [*p, p[0]] for p in parts]
    return struct.pack("<BII", 1, 3, len(closed)) + b"".join(flat(p) for p in closed)


def unwkb(blob: bytes) -> list[list[tuple[float, float]]]:
    kind = struct.unpack_from("<I", blob, 1)[0]
    if kind == 1:
        return [[struct.unpack_from("<2d", blob, 5)]]
    if kind == 2:
        return [_points(blob, 5)[0]]
    n, at, out = struct.unpack_from("<I", blob, 5)[0], 9, []
    for _ in range(n):
        points, at = _points(blob, at + (5 if kind == 5 else 0))
        out.append(points)
    return out


def _points(blob: bytes, at: int) -> tuple[list[tuple[float, float]], int]:
    n = struct.unpack_from("<I", blob, at)[0]
    v = struct.unpack_from(f"<{2 * n}d", blob, at + 4)
    return list(zip(v[::2], v[1::2], strict=True)), at + 4 + 16 * n


def _header(srs: int) -> bytes:
    return b"GP" + struct.pack("<BBi", 0, 1, srs)


_SQL = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "INTEGER"}


def write_gpkg(df: DataFrame, path: str | Path, layer: str, srs: int) -> int:
    """df (kind, parts, other columns) as a layer of a new GeoPackage; gives the number of rows.

    Rows come to the driver partition by partition. Columns that only differ in
    case get a number, others than numbers, flags and text are written as text.
    """
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.unlink(missing_ok=True)
    columns = [(f.name, _SQL.get(f.dataType.simpleString(), "TEXT")) for f in df.schema.fields if f.name not in ("kind", "parts")]
    names, used = [], {"fid", "geom"}
    for name, _ in columns:
        unique, k = name, 1
        while unique.lower() in used:
            k += 1
            unique = f"{name}__{k}"
        used.add(unique.lower())
        names.append(unique)
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA application_id = 1196444487")
        db.executescript("""
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);
        """)
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srs}", srs, srs))
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', strftime('%Y-%m-%dT%H:%M:%fZ', 'now'), NULL, NULL, NULL, NULL, ?)", (layer, layer, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, srs))
        fields = "".join(f', "{n}" {t}' for n, (_, t) in zip(names, columns, strict=True))
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{fields})')
        insert = f'INSERT INTO "{layer}" (geom{"".join(f", \"{n}\"" for n in names)}) VALUES (?{", ?" * len(names)})'
        n = 0
        for r in df.toLocalIterator():
            parts = [[(p["x"], p["y"]) for p in part] for part in r["parts"] or [] if part]
            values = [None if r[c] is None else r[c] if t != "TEXT" or isinstance(r[c], str) else json.dumps(r[c], ensure_ascii=False, cls=_Plain) for c, t in columns]
            db.execute(insert, [_header(srs) + wkb(r["kind"], parts) if parts else None, *values])
            n += 1
    db.close()
    return n


def read_gpkg(path: str | Path, layer: str | None = None) -> list[dict]:
    """Rows of a layer (the first by default), geometry as `parts`."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        layer = layer or db.execute("SELECT table_name FROM gpkg_contents").fetchone()[0]
        cursor = db.execute(f'SELECT * FROM "{layer}"')
        names = [c[0] for c in cursor.description]
        rows = [dict(zip(names, r, strict=True)) for r in cursor]
    finally:
        db.close()
    for r in rows:
        blob = r.pop("geom")
        r["parts"] = unwkb(blob[8:]) if blob else []
    return rows


def write_tiff(grid: np.ndarray, path: str | Path, xmin: float, ymax: float, res: float, nodata: float | None = None, srs: int | None = None) -> Path:
    """One band of 32-bit floats or bytes, in deflated strips, with its place and nodata."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    data = np.ascontiguousarray(grid, "<f4" if grid.dtype.kind == "f" else "u1")
    rows = max(1, (1 << 20) // max(1, data.strides[0]))
    strips = [zlib.compress(data[i : i + rows].tobytes(), 6) for i in range(0, len(data), rows)] or [zlib.compress(b"")]
    tags = [
        (256, "I", [data.shape[1]]), (257, "I", [data.shape[0]]), (258, "H", [data.itemsize * 8]), (259, "H", [8]), (262, "H", [1]), (273, "I", None), (277, "H", [1]), (278, "I", [rows]), (279, "I", [len(s) for s in strips]),
        (339, "H", [3 if data.dtype.kind == "f" else 1]), (33550, "d", [res, res, 0.0]), (33922, "d", [0.0, 0.0, 0.0, xmin, ymax, 0.0]),
    ]
    if srs:
        tags.append((34735, "H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, srs]))
    if nodata is not None:
        tags.append((42113, "s", f"{nodata:g}\0".encode()))
    size = {"H": 2, "I": 4, "d": 8, "s": 1}
    at = 8 + 2 + 12 * len(tags) + 4
    spots, extra = {}, b""
    for tag, kind, values in tags:
        n = len(strips) if values is None else len(values)
        if n * size[kind] > 4:
            spots[tag] = at + len(extra)
            extra += b"\0" * (n * size[kind] + n * size[kind] % 2)
    offsets = (np.cumsum([0] + [len(s) for s in strips[:-1]]) + at + len(extra)).tolist()
    body, directory = bytearray(extra), b""
    for tag, kind, values in tags:
        values = offsets if values is None else values
        raw = values if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        if tag in spots:
            body[spots[tag] - at : spots[tag] - at + len(raw)] = raw
            raw = struct.pack("<I", spots[tag])
        directory += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[kind], len(values)) + raw.ljust(4, b"\0")
    path.write_bytes(struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + directory + b"\0" * 4 + bytes(body) + b"".join(strips))
    return path


def ensure_dir(path: str | Path) -> Path:
    os.makedirs(path, exist_ok=True)
    return Path(path)
