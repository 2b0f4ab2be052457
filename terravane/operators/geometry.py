"""Nearest joins, buffers of points and projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.geo import EARTH_M, haversine_np
from terravane.session import cut

MAX_RIGHT = 50_000


def _nearest(li: np.ndarray, la: np.ndarray, lo: np.ndarray, ids: np.ndarray, lat: np.ndarray, lon: np.ndarray, most: float) -> pa.Table:
    """(left_id, right_id, distance_m): nearest right rows at most ``most`` away of each left row, ties kept."""
    out: list[np.ndarray] = []
    step = max(1, 1_000_000 // max(1, len(ids)))
    for s in range(0, len(li) if len(ids) else 0, step):
        d = haversine_np(la[s : s + step, None], lo[s : s + step, None], lat[None, :], lon[None, :])
        r, c = np.nonzero((d == d.min(axis=1)[:, None]) & (d <= most) & np.isfinite(d))
        out.append((li[s : s + step][r], ids[c], d[r, c]))
    cols = [np.concatenate(x) for x in zip(*out)] or [np.empty(0)] * 3
    return pa.table({"left_id": pa.array(cols[0].astype(np.int64)), "right_id": pa.array(cols[1].astype(np.int64)), "distance_m": pa.array(cols[2])})


def _cell(side: float) -> list[Column]:
    """The cell, ``side`` wide in each direction, of a place on the unit sphere."""
    p, q = F.radians("lat"), F.radians("lon")
    return [F.floor(x / side).cast("long") for x in (F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))]


def _nearest_by_cells(left: DataFrame, right: DataFrame, max_m: float | None, rows: int = 16) -> DataFrame:
    """Rounds over cells of the unit sphere: a left row is done when a right row stands in its cell or those around it, nearer than a cell is wide; the others see wider cells."""
    levels = range(0, 25)
    n = right.count()
    used = right.agg(*[F.approx_count_distinct(F.struct(*_cell(2.0 ** (1 - k)))).alias(f"c{k}") for k in levels]).first()
    level = next((k for k in levels if n <= rows * used[f"c{k}"]), levels[-1])
    found: list[DataFrame] = []

    def within(most: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def ask(a: pa.Table, b: pa.Table) -> pa.Table:
            x, y = ([t[c].to_numpy() if t.num_rows else np.empty(0) for c in ("id", "lat", "lon")] for t in (a, b))
            return _nearest(*x, *y, most)

        return ask

    while True:
        side = 2.0 ** (1 - level)
        reach = np.inf if level == 0 else 2 * EARTH_M * np.arcsin(side / 2) * (1 - 1e-9)
        most = reach if max_m is None else min(reach, max_m)

        named = [c.alias(k) for c, k in zip(_cell(side), ("a", "b", "c"))]
        around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
        sent = right.select("id", "lat", "lon", *named)
        for k in ("a", "b", "c"):
            sent = sent.withColumn("__k", F.explode(around)).withColumn(k, F.col(k) + F.col("__k")).drop("__k")
        keys = ["a", "b", "c"]
        here = left.select("id", "lat", "lon", *named).groupBy(*keys).cogroup(sent.join(left.select(*named).distinct(), keys, "left_semi").groupBy(*keys))
        got = cut(here.applyInArrow(within(most), "left_id long, right_id long, distance_m double"))
        found.append(got)
        if level == 0 or (max_m is not None and reach >= max_m):
            break
        left = cut(left.join(got.select(F.col("left_id").alias("id")), "id", "left_anti"))
        if left.isEmpty():
            break
        level = max(0, level - 3)
    return reduce(DataFrame.unionByName, found)


def nearest_join(left: DataFrame, right: DataFrame, max_m: float | None = None, max_right: int = MAX_RIGHT) -> DataFrame:
    """(left_id, right_id, distance_m): nearest right rows of each left row, ties kept; left rows without one have NULLs.

    A right side of at most ``max_right`` rows, counted first, is sent to all tasks. A larger one is met cell by cell, in cells
    that widen for left rows far from it. Both sides: (id, lat, lon); rows without a position find nothing and are not found.
    """
    known = lambda df: df.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    placed, rows = known(left), known(right)
    few = rows.limit(max_right + 1).collect()
    if len(few) <= max_right:
        ids, lat, lon = (np.array([r[c] for r in few]) for c in ("id", "lat", "lon"))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _nearest(*(b[c].to_numpy() for c in ("id", "lat", "lon")), ids, lat, lon, np.inf if max_m is None else max_m).to_batches()

        found = placed.mapInArrow(ask, "left_id long, right_id long, distance_m double")
    else:
        found = _nearest_by_cells(placed, rows, max_m)
    return left.select(F.col("id").alias("left_id")).join(found, "left_id", "left")


def point_buffer(lat: Column, lon: Column, radius_m: float, corners: int = 64) -> Column:
    """WKT of the polygon of ``corners`` points at ``radius_m`` around a point, as one expression."""
    r = radius_m / EARTH_M
    p = F.radians(lat)

    def corner(k: Column) -> Column:
        t = k * (2 * np.pi / corners)
        y = F.asin(F.sin(p) * float(np.cos(r)) + F.cos(p) * float(np.sin(r)) * F.cos(t))
        x = F.radians(lon) + F.atan2(F.sin(t) * float(np.sin(r)) * F.cos(p), F.lit(float(np.cos(r))) - F.sin(p) * F.sin(y))
        return F.format_string("%.6f %.6f", F.degrees(x), F.degrees(y))

    ring = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda k: corner(F.pmod(k, F.lit(corners))))
    return F.concat(F.lit("POLYGON (("), F.array_join(ring, ", "), F.lit("))"))


def utm_zone(lon: Column) -> Column:
    return F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing on WGS 84 by the Krueger series to order four, as column expressions."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = 2 * np.sqrt(n) / (1 + n)
    p, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(p)
    atanh = lambda c: F.log((1 + c) / (1 - c)) / 2
    t = F.sinh(atanh(s) - float(e) * atanh(s * float(e)))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, al in enumerate(alpha, 1):
        x = x + float(al) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        y = y + float(al) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    return x * (0.9996 * a) + 500_000.0, y * (0.9996 * a) + F.when(lat < 0, F.lit(10_000_000.0)).otherwise(F.lit(0.0))
