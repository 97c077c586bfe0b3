"""Map projections: Web Mercator as Columns, the Albers composite, Mercator shapes and GeoJSON centroids in Arrow batches, slippy tiles."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Unit square positions: x = lon/360 and y by the Mercator formula, both 0 at (0, 0), y growing southward."""
    x = F.radians(lon) / F.lit(2 * math.pi)
    y = -F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) / F.lit(2 * math.pi)
    return x, y


def geo_to_canvas(lon: Column, lat: Column, center: tuple[float, float], level: int, width: int, height: int) -> tuple[Column, Column]:
    """Canvas position at a map zoom level, with the centre (lon, lat) in the middle of a width x height viewport."""
    scale = float(2 ** (level + 8))
    cx = math.radians(center[0]) / (2 * math.pi) * scale
    cy = -math.log(math.tan(math.pi / 4 + math.radians(center[1]) / 2)) / (2 * math.pi) * scale
    x, y = mercator(lon, lat)
    return x * F.lit(scale) - F.lit(cx - width / 2), y * F.lit(scale) - F.lit(cy - height / 2)


def _conic(lon, lat, parallels: tuple[float, float], rotate: float, center: tuple[float, float]):
    """Albers equal-area conic on the unit sphere, y upward, with `center` (rotated longitude, latitude) at the origin."""
    s1, s2 = (math.sin(math.radians(p)) for p in parallels)
    n = (s1 + s2) / 2
    c = 1 + s1 * (2 * n - s1)

    def raw(l, phi):
        r = np.sqrt(np.maximum(c - 2 * n * np.sin(np.radians(phi)), 0)) / n
        return r * np.sin(n * np.radians(l)), math.sqrt(c) / n - r * np.cos(n * np.radians(l))

    x, y = raw(np.mod(lon + rotate + 180.0, 360.0) - 180.0, lat)
    x0, y0 = raw(center[0], center[1])
    return x - x0, y - y0


def albers_usa(lon: np.ndarray, lat: np.ndarray, scale: float = 1070.0, width: float = 960.0, height: float = 500.0):
    """The public composite projection of the 50 states: the lower 48, with Alaska (at 0.35 of the scale) and Hawaii in frames below. Points in none of the three
    frames are NaN."""
    lon, lat = np.asarray(lon, dtype=float), np.asarray(lat, dtype=float)
    # fixed values: parallels, rotation, centre, share of the scale, place, and frame (left, top, right, bottom) in units of the scale
    parts = [
        ((29.5, 45.5), 96.0, (-0.6, 38.7), 1.0, (0.0, 0.0), (-0.455, -0.238, 0.455, 0.238)),
        ((55.0, 65.0), 154.0, (-2.0, 58.5), 0.35, (-0.307, 0.201), (-0.425, 0.120, -0.214, 0.234)),
        ((8.0, 18.0), 157.0, (-3.0, 19.9), 1.0, (-0.205, 0.212), (-0.214, 0.166, -0.115, 0.234)),
    ]
    px, py = np.full(lon.shape, np.nan), np.full(lon.shape, np.nan)
    for parallels, rotate, center, share, (dx, dy), (x0, y0, x1, y1) in parts:
        x, y = _conic(lon, lat, parallels, rotate, center)
        x, y = x * share + dx, dy - y * share
        hit = np.isnan(px) & (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
        px, py = np.where(hit, x, px), np.where(hit, y, py)
    return px * scale + width / 2, py * scale + height / 2


def mercator_shape(lon: np.ndarray, lat: np.ndarray, scale: float, width: float, height: float):
    """Mercator with (-98.5, 39.5) in the middle."""
    up = lambda v: np.log(np.tan(math.pi / 4 + np.radians(v) / 2))
    return scale * np.radians(np.asarray(lon, dtype=float) + 98.5) + width / 2, height / 2 - scale * (up(np.asarray(lat, dtype=float)) - up(39.5))


PROJECTIONS = ("albers", "mercator")


def projection(name: str, width: float, height: float):
    """The projection of a map canvas: lon, lat arrays to pixels."""
    if name == "albers":
        return lambda lon, lat: albers_usa(lon, lat, width, width, height)
    if name == "mercator":
        return lambda lon, lat: mercator_shape(lon, lat, 8192 / (2 * math.pi) * width / 2000, width, height)
    raise ValueError(f"unknown projection {name!r}")


def _rings(geometry: dict) -> list[np.ndarray]:
    """All rings, holes among them; holes run the other way round, so they take away from area and centroid."""
    kind, c = geometry.get("type"), geometry.get("coordinates") or []
    if kind == "Polygon":
        return [np.asarray(r, dtype=float) for r in c]
    if kind == "MultiPolygon":
        return [np.asarray(r, dtype=float) for p in c for r in p]
    if kind in ("Point", "MultiPoint"):
        return [np.asarray([c] if kind == "Point" else c, dtype=float)]
    if kind == "GeometryCollection":
        return [r for g in geometry.get("geometries") or [] for r in _rings(g)]
    return []


def shape_of(text: str | None, project) -> tuple[float, float, float, float]:
    """(centroid x, centroid y, width, height) of a projected GeoJSON geometry; 0 where it is bad, empty or off the map. Edges are straight on the map."""
    try:
        g = json.loads(text or "")
        rings = _rings(g.get("geometry", g))
        area = sx = sy = 0.0
        points = []
        for r in rings:
            x, y = project(r[:, 0], r[:, 1])
            seen = np.isfinite(x) & np.isfinite(y)
            x, y = x[seen], y[seen]
            points.append(np.stack([x, y], 1))
            x2, y2 = np.roll(x, -1), np.roll(y, -1)
            cross = x * y2 - x2 * y
            area, sx, sy = area + cross.sum() / 2, sx + ((x + x2) * cross).sum() / 6, sy + ((y + y2) * cross).sum() / 6
        every = np.concatenate(points)
        lo, hi = every.min(0), every.max(0)
        cx, cy = (sx / area, sy / area) if abs(area) > 1e-12 else tuple(every.mean(0))
        out = (cx, cy, hi[0] - lo[0], hi[1] - lo[1])
        return tuple(float(v) if math.isfinite(v) else 0.0 for v in out)
    except (ValueError, TypeError, KeyError, IndexError, AttributeError):
        return (0.0, 0.0, 0.0, 0.0)


def geojson_shape(name: str, width: float, height: float):
    """Function of a GeoJSON column: (cx, cy, width, height) on a map canvas, in Arrow batches."""

    @F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("cx", "cy", "width", "height")]))
    def shape(text: pd.Series) -> pd.DataFrame:
        project = projection(name, width, height)
        return pd.DataFrame([shape_of(t, project) for t in text], columns=["cx", "cy", "width", "height"])

    return shape


def slippy_tiles(df: DataFrame, minx: str, miny: str, maxx: str, maxy: str, level: int) -> DataFrame:
    """One row for each 256-pixel map tile that a viewport (in pixels of the level) touches: tile_x (wrapped), tile_y, left, top."""
    n = 2**level
    side = F.lit(256.0)
    xs = F.sequence(F.floor(F.col(minx) / side), F.floor(F.col(maxx) / side))
    ys = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(F.col(miny) / side)), F.least(F.lit(n - 1).cast("long"), F.floor(F.col(maxy) / side)))
    rows = df.where((F.col(miny) < n * 256) & (F.col(maxy) >= 0)).withColumn("__x", F.explode(xs)).withColumn("__y", F.explode(ys))
    return rows.withColumns({"tile_x": F.pmod("__x", F.lit(n)), "tile_y": F.col("__y"), "left": F.col("__x") * 256, "top": F.col("__y") * 256}).drop("__x", "__y")
