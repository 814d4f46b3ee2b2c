"""Projected zones of CGCS2000, their recommendation and validation, and transverse Mercator itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

THREE = {75 + 3 * i: 4534 + i for i in range(21)}
SIX = {75 + 6 * i: 4491 + i for i in range(11)}
_A, _F = 6378137.0, 1 / 298.257222101


def parse_epsg(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(F.trim(text)), r"^(?:EPSG:)?(\d+)$", 1), F.lit("")).try_cast("int")


def _table(pairs: dict[int, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key)


def central_meridian(epsg: Column) -> Column:
    return _table({v: k for k, v in {**THREE}.items()} | {v: k for k, v in SIX.items()}, epsg)


def nearest_3(lon: Column) -> Column:
    """Central meridian of the 3-degree zone; halves go to the even multiple."""
    return F.least(F.greatest((F.bround(lon / 3.0) * 3).cast("int"), F.lit(75)), F.lit(135))


def nearest_6(lon: Column) -> Column:
    return F.least(F.greatest((F.bround((lon - 3.0) / 6.0) * 6 + 3).cast("int"), F.lit(75)), F.lit(135))


def distortion(cm: Column, lon: Column) -> Column:
    return F.pow(F.radians(F.abs(lon - cm)) * 0.8660254037844387, F.lit(2.0)) / 2


def recommend(lon_min: Column, lon_max: Column) -> Column:
    """struct<epsg, meridian, distortion>: one 3-degree zone, or a 6-degree one for more than 3 degrees."""
    lon = (lon_min + lon_max) / 2
    wide = lon_max - lon_min > 3.0
    cm = F.when(wide, nearest_6(lon)).otherwise(nearest_3(lon))
    return F.struct(F.when(wide, _table(SIX, cm)).otherwise(_table(THREE, cm)).alias("epsg"), cm.alias("meridian"), distortion(cm, lon).alias("distortion"))


def validate(declared: Column, lon_min: Column, lon_max: Column, most: float = 5e-4) -> Column:
    code = parse_epsg(declared)
    cm = central_meridian(code)
    return F.when(code.isNull(), "error").when(lon_min.isNull() | lon_max.isNull(), "info").when(cm.isNull(), "info").when(distortion(cm, (lon_min + lon_max) / 2) > most, "warning").otherwise("ok")


def _series() -> tuple[float, list[float], list[float], list[float]]:
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return radius, alpha, beta, delta


def project(lon: np.ndarray, lat: np.ndarray, meridian: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing by Krueger's series; scale 1 and false easting 500 km."""
    radius, alpha, _, _ = _series()
    n = _F / (2 - _F)
    e = 2 * np.sqrt(n) / (1 + n)
    phi, lam = np.radians(lat), np.radians(lon - meridian)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x, y = eta.copy(), xi.copy()
    for j, a in enumerate(alpha, 1):
        x += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return 500000.0 + radius * x, radius * y


def unproject(x: np.ndarray, y: np.ndarray, meridian: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of an easting and northing."""
    radius, _, beta, delta = _series()
    xi, eta = y / radius, (x - 500000.0) / radius
    a, b = xi.copy(), eta.copy()
    for j, w in enumerate(beta, 1):
        a -= w * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        b -= w * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(a) / np.cosh(b))
    phi = chi.copy()
    for j, d in enumerate(delta, 1):
        phi += d * np.sin(2 * j * chi)
    return np.degrees(np.arctan2(np.sinh(b), np.cos(a))) + meridian, np.degrees(phi)


def _plane(lon: pd.Series, lat: pd.Series, meridian: pd.Series) -> pd.DataFrame:
    x, y = project(lon.to_numpy(float), lat.to_numpy(float), meridian.to_numpy(float))
    return pd.DataFrame({"x": x, "y": y})


def _lonlat(x: pd.Series, y: pd.Series, meridian: pd.Series) -> pd.DataFrame:
    lon, lat = unproject(x.to_numpy(float), y.to_numpy(float), meridian.to_numpy(float))
    return pd.DataFrame({"lon": lon, "lat": lat})


def to_plane(lon, lat, meridian) -> Column:
    return F.pandas_udf(_plane, "struct<x: double, y: double>")(lon, lat, meridian)


def to_lonlat(x, y, meridian) -> Column:
    return F.pandas_udf(_lonlat, "struct<lon: double, lat: double>")(x, y, meridian)
