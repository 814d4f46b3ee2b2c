"""Vector and raster files: GeoJSON through the JSON reader, shapefiles and GeoTIFF headers from binary files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURES = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, ordinal, gtype, coordinates, attrs) of every feature under a folder; files without features give no row."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.geojson").schema(_FEATURES).json(path)
    f = raw.select(F.input_file_name().alias("source_path"), F.posexplode("features").alias("ordinal", "f"))
    return f.filter("f.geometry IS NOT NULL").select("source_path", "ordinal", F.col("f.geometry.type").alias("gtype"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("attrs"))


def parse_shp(data: bytes) -> list[tuple[int, str, list[float], list[float], list[int]]]:
    """(record, type, xs, ys, part starts) of a shapefile's points, lines and polygons; null shapes are left out."""
    kinds, out, at = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}, [], 100
    while at + 12 <= len(data):
        number, words = struct.unpack(">2i", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == 1:
            xy = struct.unpack("<2d", body[4:20])
            out.append((number, kinds[1], [xy[0]], [xy[1]], [0]))
        elif kind in (3, 5):
            parts, points = struct.unpack("<2i", body[36:44])
            first = list(struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]))
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            out.append((number, kinds[kind], list(flat[::2]), list(flat[1::2]), first))
        at += 8 + 2 * words
    return out


def write_shp(shapes: list[tuple[str, list[tuple[float, float]]]]) -> bytes:
    """A shapefile's bytes of single-part lines and polygons, or points."""
    body = b""
    for i, (kind, points) in enumerate(shapes, 1):
        xs, ys = zip(*points, strict=True)
        if kind == "Point":
            rec = struct.pack("<i2d", 1, xs[0], ys[0])
        else:
            rec = struct.pack("<i4d2ii", {"LineString": 3, "Polygon": 5}[kind], min(xs), min(ys), max(xs), max(ys), 1, len(points), 0) + struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p])
        body += struct.pack(">2i", i, len(rec) // 2) + rec
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 0, *[0.0] * 8) + body


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def read_shp(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, ordinal, gtype, xs, ys, parts, error): a file that can't be read gives one row with its error."""

    def work(batches):
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(name, n, k, xs, ys, p, None) for n, k, xs, ys, p in parse_shp(bytes(data))]
                except (struct.error, KeyError) as e:
                    rows.append((name, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["source_path", "ordinal", "gtype", "xs", "ys", "parts", "error"])

    return _files(spark, path, "*.shp").filter("path NOT LIKE '%.gdb%'").select("path", "content").mapInPandas(work, "source_path string, ordinal int, gtype string, xs array<double>, ys array<double>, parts array<int>, error string")


def parse_dbf(data: bytes) -> list[dict[str, str]]:
    """Attributes of each record as text, blanks left out; UTF-8, else GBK. Deleted records stay, so that places match the shapes'."""
    count, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((_text(data[at : at + 11].split(b"\0")[0]), data[at + 16]))
        at += 32
    out = []
    for i in range(count):
        place, row = head + i * width + 1, {}
        for name, size in fields:
            value = _text(data[place : place + size]).strip(" \0")
            if value:
                row[name] = value
            place += size
        out.append(row)
    return out


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("gbk", "replace")


def write_dbf(rows: list[dict[str, str]]) -> bytes:
    """A table of text fields."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    width = {n: min(254, max(1, *(len(r.get(n, "").encode()) for r in rows))) for n in names}
    head = b"".join(n.encode()[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width[n], 0]) + b"\0" * 14 for n in names)
    body = b"".join(b" " + b"".join(r.get(n, "").encode()[: width[n]].ljust(width[n]) for n in names) for r in rows)
    return struct.pack("<B3BIHH20x", 3, 126, 1, 1, len(rows), 33 + len(head), 1 + sum(width.values())) + head + b"\r" + body + b"\x1a"


def scan_shp(spark: SparkSession, path: str) -> DataFrame:
    """read_shp with the attributes of the .dbf beside each file; none where that is missing or broken."""

    def work(batches):
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(name[:-4], i, r) for i, r in enumerate(parse_dbf(bytes(data)), 1)]
                except (struct.error, IndexError):
                    continue
            yield pd.DataFrame(rows, columns=["_stem", "ordinal", "attrs"])

    table = _files(spark, path, "*.dbf").select("path", "content").mapInPandas(work, "_stem string, ordinal int, attrs map<string,string>")
    shapes = read_shp(spark, path).withColumn("_stem", F.expr("left(source_path, length(source_path) - 4)"))
    return shapes.join(table, ["_stem", "ordinal"], "left").drop("_stem")


_TIFF = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d")}


def _tags(data: bytes) -> tuple[str, dict]:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        size, code = _TIFF.get(kind, (1, "B"))
        where = at + 10 + 12 * i
        if size * n > 4:
            where = struct.unpack(order + "I", data[where : where + 4])[0]
        raw = data[where : where + size * n]
        tags[tag] = raw.split(b"\0")[0].decode() if code == "s" else struct.unpack(f"{order}{n}{code}", raw)
    return order, tags


def _dtype(tags: dict) -> str:
    bits, form = tags.get(258, (8,))[0], tags.get(339, (1,))[0]
    return f"{ {1: 'uint', 2: 'int', 3: 'float'}.get(form, 'uint')}{bits}".replace(" ", "")


def tiff_header(data: bytes) -> dict:
    """Size, cell size, origin, nodata, type, bands and EPSG code of a GeoTIFF from its first directory."""
    _, tags = _tags(data)
    scale, tie = tags.get(33550, (None, None)), tags.get(33922, (None,) * 6)
    text, keys = tags.get(42113), tags.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    return {"width": tags[256][0], "height": tags[257][0], "res_x": scale[0], "res_y": scale[1], "xmin": tie[3], "ymax": tie[4], "nodata": float(text) if text else None, "dtype": _dtype(tags), "bands": tags.get(277, (1,))[0], "epsg": codes.get(3072, codes.get(2048))}


def read_tiff(data: bytes) -> np.ndarray:
    """The first band of a strip GeoTIFF, plain or deflated (no predictor), as an array of rows."""
    order, tags = _tags(data)
    pack = tags.get(259, (1,))[0]
    if pack not in (1, 8, 32946) or tags.get(317, (1,))[0] != 1 or 322 in tags:
        raise ValueError("only plain or deflated strips are read")
    width, height, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    strips = [data[a : a + n] for a, n in zip(tags[273], tags[279], strict=True)]
    raw = b"".join(strips if pack == 1 else map(zlib.decompress, strips))
    return np.frombuffer(raw, np.dtype(_dtype(tags)).newbyteorder(order))[: width * height * bands].reshape(height, width, bands)[:, :, 0]


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, r, c, value) of the first band of every raster under a folder that can be read; nodata is null."""

    def work(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                grid, nodata = read_tiff(bytes(data)).astype(float), tiff_header(bytes(data))["nodata"]
                if nodata is not None:
                    grid = np.where(grid == nodata, np.nan, grid)
                step = max(1, 65536 // grid.shape[1])
                for r in range(0, len(grid), step):
                    part = grid[r : r + step]
                    at = np.indices(part.shape)
                    yield pd.DataFrame({"path": name, "r": (at[0] + r).ravel(), "c": at[1].ravel(), "value": pd.Series(part.ravel()).astype(object).where(~np.isnan(part.ravel()), None)})

    return _files(spark, path, "*.tif*").select("path", "content").mapInPandas(work, "path string, r int, c int, value double")


def raster_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per .tif under a folder, with what its header says, or the error."""
    names = ["width", "height", "res_x", "res_y", "xmin", "ymax", "nodata", "dtype", "bands", "epsg"]

    def work(batches):
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    h = tiff_header(bytes(data))
                    rows.append((name, *[h[n] for n in names], None))
                except (struct.error, KeyError, ValueError) as e:
                    rows.append((name, *[None] * len(names), str(e)))
            yield pd.DataFrame(rows, columns=["path", *names, "error"])

    return _files(spark, path, "*.tif*").select("path", "content").mapInPandas(work, "path string, width int, height int, res_x double, res_y double, xmin double, ymax double, nodata double, dtype string, bands int, epsg int, error string")
