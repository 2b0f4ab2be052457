"""Positions, great-circle metric and point-in-polygon: columns where Catalyst can do it, numpy kernels where it cannot."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean radius of the earth, metres.
EARTH_M = 6_371_008.8
_NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: x and y of a point in WKT, EWKT or GeoJSON text, as one group.
POINT = rf'(?i)(?:^\s*(?:SRID\s*=\s*\d+\s*;)?\s*POINT\s*(?:ZM|Z|M)?\s*\(|"coordinates"\s*:\s*\[)\s*({_NUM}[\s,]+{_NUM})'


def usable(lat: Column, lon: Column) -> Column:
    """Present, in range and not 0,0. NaN fails the range test because NaN is above every number."""
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0.0) & (lon == 0.0)), F.lit(False))


def with_position(rows: DataFrame, keep: list[Column], lat: Column, lon: Column, geometry: Column) -> DataFrame:
    """``keep`` with lat and lon: the two columns if usable, else the point in the geometry text if usable; rows without are left out.

    The text is only read where the columns fail, once per row: each step is a projection of its own.
    """
    ok = usable(lat, lon)
    first = rows.select(*keep, F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"), F.when(~ok, geometry).alias("__g"))
    names = [c for c in first.columns if c != "__g"]
    told = first.select(*names, F.when(F.col("__g").isNotNull(), F.split(F.regexp_extract("__g", POINT, 1), r"[\s,]+")).alias("__p"))
    told = told.select(*names, F.when(F.size("__p") == 2, F.col("__p")[0]).try_cast("double").alias("__x"), F.when(F.size("__p") == 2, F.col("__p")[1]).try_cast("double").alias("__y"))
    use = usable(F.col("__y"), F.col("__x"))
    place = F.when(F.col("lat").isNotNull(), F.array(F.struct("lat", "lon"))).when(use, F.array(F.struct(F.col("__y").alias("lat"), F.col("__x").alias("lon"))))
    # rows without a position end in the generator; a filter would be pushed down and the text be read again for each of its terms
    return told.select(*names[:-2], F.inline(place))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lon)
    c = np.cos(p)
    return np.stack([c * np.cos(q), c * np.sin(q), np.sin(p)], axis=1)


def arc_m(chord: np.ndarray) -> np.ndarray:
    return 2 * EARTH_M * np.arcsin(np.minimum(chord / 2, 1.0))


def haversine_np(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat1), np.radians(lat2)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(np.sqrt(h), 1.0))


def polygons(text: str | None) -> list[list[np.ndarray]]:
    """Polygons of GeoJSON text, each a list of rings (outer first); empty, unreadable and other shapes give none."""
    try:
        shape = json.loads(text or "null")
        if isinstance(shape, dict) and shape.get("type") == "Feature":
            shape = shape.get("geometry")
        kind, parts = (shape or {}).get("type"), (shape or {}).get("coordinates") or []
        many = parts if kind == "MultiPolygon" else [parts] if kind == "Polygon" else []
        out = []
        for poly in many:
            rings = [np.array([[float(p[0]), float(p[1])] for p in ring]) for ring in poly if len(ring) >= 3]
            if rings and len(poly[0]) >= 3:
                out.append(rings)
        return out
    except (ValueError, TypeError, KeyError, AttributeError, IndexError):
        return []


def in_ring(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strictly inside by even-odd, on the boundary) of each point, in plane coordinates."""
    inside, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
    a, b = ring, np.roll(ring, -1, axis=0)
    for (ax, ay), (bx, by) in zip(a, b):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        edge |= (cross == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
        if ay != by:
            spans = (ay > y) != (by > y)
            inside ^= spans & ((cross > 0) == (by > ay))
    return inside, edge


def in_polygon(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Inside the outer ring or on it, and not strictly inside a hole."""
    inside, edge = in_ring(x, y, rings[0])
    hit = inside | edge
    for hole in rings[1:]:
        within, rim = in_ring(x, y, hole)
        hit &= ~(within & ~rim)
    return hit
