"""Graphs of points at most a radius apart, without a list of their edges.

Points are cut into tiles of about equal numbers; a tile holds its own points (home) and all others within the radius of one.

Spanning forest: from a point, only the nearest others of each eighth of the circle can be edges of the forest, because two points of one
eighth are nearer to each other than the further one is to the point; what is nearer than CLOSE_M or as near as rounding can tell is kept
beside. Each tile takes its edges in the order (weight, src, dst). Of two parts that an edge joins, one without points of other tiles has
all edges that leave it in this tile, so the edge is one of the whole forest; the few others are decided together. The order is total, so
the forest is that of the list of all edges.

Defined cases: points at one position are joined to the smallest id among them; points without a position are alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.geo import EARTH_M, haversine_np, unit
from terravane.operators.graph import _rounds_of_merging, components, corridors_of
from terravane.operators.neighbours import tiles
from terravane.session import cut

TILE_ROWS = 20_000
CLOSE_M, EVEN_M = 1e-3, 1e-6
CANDIDATES = 2_000_000
MAX_LEFT = 200_000
INSIDE, ACROSS, OPEN, HOME, LINK = range(5)


def _with_place(points: DataFrame) -> DataFrame:
    known = points.where(F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    return known.select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


class Reach:
    """The tiles that have a point within the radius of a point, across the date line and the poles too."""

    def __init__(self, points: DataFrame, radius_m: float, rows: int = TILE_ROWS) -> None:
        self.grid = tiles(points.select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), rows)
        self.turn = radius_m / EARTH_M + 1e-9

    def of(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tile, point, is home)."""
        wide, turn = np.full(len(lat), 360.0), self.turn
        inner = np.radians(np.abs(lat)) + turn < np.pi / 2
        wide[inner] = np.degrees(np.arcsin(np.sin(turn) / np.cos(np.radians(lat[inner]))))
        far = np.maximum(wide, np.degrees(turn)) + 1e-9
        own = self.grid.of(lon, lat)
        key = [own * np.int64(len(lat)) + np.arange(len(lat))]
        for shift in (0.0, -360.0, 360.0):
            at = np.arange(len(lat)) if shift == 0 else np.flatnonzero(lon + far > 180 if shift < 0 else lon - far < -180)
            tile, point = self.grid.reached(lon[at] + shift, lat[at], far[at])
            key.append(tile.astype(np.int64) * len(lat) + at[point])
        tile, point = np.divmod(np.unique(np.concatenate(key)), max(len(lat), 1))
        return tile.astype(np.int32), point, own[point] == tile


def tiled(points: DataFrame, radius_m: float, rows: int = TILE_ROWS) -> DataFrame:
    """(tile, id, lat, lon, home): every point in its own tile and in all that have a point within the radius of it. points: (id long, lat, lon)."""
    known = _with_place(points)
    reach = Reach(known, radius_m, rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tile, point, home = reach.of(b["lat"].to_numpy(), b["lon"].to_numpy())
            take = pa.array(point)
            yield pa.RecordBatch.from_arrays([pa.array(tile), b["id"].take(take), b["lat"].take(take), b["lon"].take(take), pa.array(home)], ["tile", "id", "lat", "lon", "home"])

    return known.mapInArrow(place, "tile int, id long, lat double, lon double, home boolean")


class Cells:
    """Points of a tile in cubes of a side; the candidates of a cube are in nine runs of the order kept."""

    def __init__(self, u: np.ndarray, side: float) -> None:
        side = max(side, float(np.ptp(u, axis=0).max()) / 2**20, 1e-15)
        cell = np.floor((u - u.min(axis=0)) / side).astype(np.int64) + 1
        self.code = (cell[:, 0] * 2**21 + cell[:, 1]) * 2**21 + cell[:, 2]
        self.order = np.argsort(self.code, kind="stable")
        self.sorted = self.code[self.order]

    def runs(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, number) of the nine runs around each code, one row each."""
        at = code[:, None] + np.array([(x * 2**21 + y) * 2**21 for x in (-1, 0, 1) for y in (-1, 0, 1)])
        first = np.searchsorted(self.sorted, at - 1, side="left")
        return first, np.searchsorted(self.sorted, at + 1, side="right") - first

    def pairs(self, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asking, other) candidates, all of an asking point at once."""
        first, n = self.runs(self.code[asking])
        ends = np.cumsum(n.sum(axis=1))
        at = 0
        while at < len(asking):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, side="right")))
            m = n[at:to].ravel()
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[at:to].ravel(), m)
            i, j = np.repeat(asking[at:to], n[at:to].sum(axis=1)), self.order[k]
            yield i[i != j], j[i != j]
            at = to


def sector_edges(u: np.ndarray, lat: np.ndarray, lon: np.ndarray, asking: np.ndarray, radius_m: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the points b nearest to each asking a in each eighth of the circle, within about the radius; the search widens until all eighths are filled."""
    p, q = np.radians(lat), np.radians(lon)
    east, north = np.stack([-np.sin(q), np.cos(q)], axis=1), np.stack([-np.sin(p) * np.cos(q), -np.sin(p) * np.sin(q), np.cos(p)], axis=1)
    most = radius_m * (1 + 1e-9) + EVEN_M
    reach = min(most, max(CLOSE_M, float(np.linalg.norm(np.ptp(u, axis=0))) * EARTH_M * np.sqrt(4 / max(len(u), 1))))
    left, right, todo = [], [], asking
    while len(todo):
        cells, wait = Cells(u, reach / EARTH_M), []
        for i, j in cells.pairs(todo):
            gap = u[j] - u[i]
            d = np.sqrt((gap * gap).sum(axis=1)) * EARTH_M
            near = d <= reach
            i, j, d, gap = i[near], j[near], d[near], gap[near]
            part = np.floor(np.arctan2((gap * north[i]).sum(axis=1), (gap[:, :2] * east[i]).sum(axis=1)) / (np.pi / 4)).astype(np.int64) % 8
            key, close = i * 8 + part, d < CLOSE_M
            i0, j0, key, d = i[close], j[close], key[~close], d[~close]
            i, j = i[~close], j[~close]
            order = np.lexsort((d, key))
            i, j, key, d = i[order], j[order], key[order], d[order]
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            best = d[np.flatnonzero(new)][new.cumsum() - 1] if len(key) else d
            keep = d <= best + EVEN_M
            full = np.bincount(i[new], minlength=len(u)) == 8
            a, b = np.concatenate([i0, i[keep]]), np.concatenate([j0, j[keep]])
            ready = full[a] | (reach >= most)
            left.append(a[ready])
            right.append(b[ready])
            wait.append(full)
        full = np.logical_or.reduce(wait)
        todo = todo[~full[todo]] if reach < most else todo[:0]
        reach = min(most, 2 * reach)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


class Union:
    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, v: int) -> int:
        parent = self.parent
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v


def _tile_forest(t: pa.Table, radius_m: float) -> pa.Table:
    """Rows (kind, a, b, w, c): edges (src, dst, weight, label) inside a tile, across tiles, and left open; home points (id, label, -, sure label); links of other tiles' points in the same form."""
    ids, lat, lon, home = (t[c].to_numpy() for c in ("id", "lat", "lon", "home"))
    order = np.lexsort((ids, lon, lat))
    ids, lat, lon, home = ids[order], lat[order], lon[order], home[order]
    new = np.ones(len(ids), bool)
    new[1:] = (lat[1:] != lat[:-1]) | (lon[1:] != lon[:-1])
    at, first = new.cumsum() - 1, np.flatnonzero(new)
    rep, plat, plon, phome = ids[first], lat[first], lon[first], home[first]
    a, b = sector_edges(unit(plat, plon), plat, plon, np.flatnonzero(phome), radius_m)
    a, b = np.where(rep[a] < rep[b], a, b), np.where(rep[a] < rep[b], b, a)
    a, b = np.divmod(np.unique(a * np.int64(len(rep)) + b), len(rep))
    w = haversine_np(plat[a], plon[a], plat[b], plon[b])
    fit = w <= radius_m
    a, b, w = a[fit], b[fit], w[fit]
    order = np.lexsort((rep[b], rep[a], w))
    a, b, w = a[order], b[order], w[order]
    all_, sure, foreign = Union(len(rep)), Union(len(rep)), (~phome).tolist()
    taken, kind = [], []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = all_.root(i), all_.root(j)
        if x == y:
            continue
        taken.append(k)
        if foreign[x] and foreign[y]:
            kind.append(OPEN)
        else:
            kind.append(INSIDE)
            sure.parent[sure.root(i)] = sure.root(j)
        all_.parent[x] = y
        foreign[y] = foreign[x] or foreign[y]
    a, b, w, kind = a[taken], b[taken], w[taken], np.array(kind, np.int32)
    kind[(kind == INSIDE) & ~(phome[a] & phome[b])] = ACROSS

    def label(of: Union) -> np.ndarray:  # the smallest home id of each part, or the id itself
        roots = np.array([of.root(v) for v in range(len(rep))], np.int64)
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, roots[phome], rep[phome])
        return np.where(least[roots] < np.iinfo(np.int64).max, least[roots], rep)

    one, two = label(all_), label(sure)
    again = np.flatnonzero(~new & home)  # other points of a position
    met = np.zeros(len(rep), bool)
    met[np.concatenate([a, b])] = True
    met = np.flatnonzero(met & ~phome)
    own = np.flatnonzero(home)
    cols = [
        np.concatenate([kind, np.full(len(again), INSIDE), np.full(len(own), HOME), np.full(len(met), LINK)]).astype(np.int32),
        np.concatenate([rep[a], rep[at[again]], ids[own], rep[met]]),
        np.concatenate([rep[b], ids[again], one[at[own]], one[met]]),
        np.concatenate([w, np.zeros(len(again) + len(own) + len(met))]),
        np.concatenate([one[a], one[at[again]], two[at[own]], two[met]]),
    ]
    return pa.table(dict(zip(("kind", "a", "b", "w", "c"), cols)))


def forest(points: DataFrame, radius_m: float, rows: int = TILE_ROWS) -> DataFrame:
    """What the tiles know of the spanning forest, for ``components_within`` and ``spanning_tree_within``."""
    return cut(tiled(points, radius_m, rows).groupBy("tile").applyInArrow(lambda t: _tile_forest(t, radius_m), "kind int, a long, b long, w double, c long"))


def _moved(made: DataFrame) -> DataFrame:
    """(label, component) of the labels of tiles that are part of something larger."""
    home, link = made.where(F.col("kind") == HOME), made.where(F.col("kind") == LINK)
    pairs = cut(link.select("a", F.col("b").alias("src")).join(home.select("a", F.col("b").alias("dst")), "a").select("src", "dst").distinct())
    ends = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    return components(ends, pairs).select(F.col("id").alias("label"), "component")


def components_within(points: DataFrame, radius_m: float, made: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id of each connected component of points at most ``radius_m`` apart."""
    made = forest(points, radius_m) if made is None else made
    home = made.where(F.col("kind") == HOME).select(F.col("a").alias("id"), F.col("b").alias("label")).join(_moved(made), "label", "left").select("id", F.coalesce("component", "label").alias("component"))
    return points.select("id").join(home, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _open_edges(made: DataFrame, most: int) -> DataFrame:
    """Those of the edges left open that are in the forest: the parts of sure edges are contracted, then the least edges taken."""
    left = cut(made.where(F.col("kind") == OPEN).select(F.col("c").alias("component"), F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight")).dropDuplicates(["src", "dst"]))
    link = made.where(F.col("kind") == LINK).select(F.col("a").alias("src"), F.col("c").alias("dst"))
    asked = cut(left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).unionByName(link.select(F.col("src").alias("id"))).distinct())
    known = made.where(F.col("kind") == HOME).join(asked.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("a").alias("src"), F.col("c").alias("dst"))
    joined = cut(link.unionByName(known).where("src <> dst").distinct())
    ends = asked.unionByName(joined.select(F.col("dst").alias("id"))).distinct()
    part = components(ends, joined).select("id", F.col("component").alias("part"))
    schema = "component long, src long, dst long, weight double"
    if left.count() > most:
        return _rounds_of_merging(left, part)
    a, b = part.select(F.col("id").alias("src"), F.col("part").alias("pa")), part.select(F.col("id").alias("dst"), F.col("part").alias("pb"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "src", "dst"])
        codes = pd.factorize(pd.concat([pdf["pa"], pdf["pb"]]))[0]
        parts, keep = Union(2 * len(pdf)), []
        for i, j in zip(codes[: len(pdf)].tolist(), codes[len(pdf) :].tolist()):
            x, y = parts.root(i), parts.root(j)
            keep.append(x != y)
            parts.parent[x] = y
        return pdf[keep][["component", "src", "dst", "weight"]]

    return left.join(a, "src").join(b, "dst").where("pa <> pb").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(one, schema)


def spanning_tree_within(points: DataFrame, radius_m: float, made: DataFrame | None = None, most: int = MAX_LEFT) -> DataFrame:
    """(component, src, dst, weight) of the minimum spanning forest of points at most ``radius_m`` apart, ties by (weight, src, dst).

    Up to ``most`` edges that tiles leave open are decided in one task, more of them by rounds of merging.
    """
    made = forest(points, radius_m) if made is None else made
    edge = made.select("kind", F.col("c").alias("component"), F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight"))
    across = edge.where(F.col("kind") == ACROSS).drop("kind").dropDuplicates(["src", "dst"])
    tree = edge.where(F.col("kind") == INSIDE).drop("kind").unionByName(across).unionByName(_open_edges(made, most))
    moved = _moved(made).withColumnRenamed("component", "now")
    return tree.join(moved, tree["component"] == moved["label"], "left").select(F.coalesce("now", "component").alias("component"), "src", "dst", "weight")


class Metres:
    """Great-circle distances of a tile's points, from chords."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, radius_m: float) -> None:
        self.lat, self.lon, self.radius = lat, lon, radius_m
        self.u = unit(lat, lon)
        self.cells = Cells(self.u, (radius_m * (1 + 1e-9) + EVEN_M) / EARTH_M)
        self.xyz = (self.u - (self.u[0] if len(lat) else 0)).T * EARTH_M

    def groups(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of one cell, all that may be near them)."""
        rows = rows[np.argsort(self.cells.code[rows], kind="stable")]
        code = self.cells.code[rows]
        edge = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(rows) else np.empty(0, int)
        first, n = self.cells.runs(code[edge])
        for k, (lo, hi) in enumerate(zip(edge, np.append(edge[1:], len(rows)))):
            yield rows[lo:hi], np.concatenate([self.cells.order[a : a + m] for a, m in zip(first[k], n[k])])

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distance of each of a to each of b, infinite beyond the radius."""
        x, y, z = self.xyz
        d = np.subtract.outer(x[a], x[b])
        d *= d
        for c in (y, z):
            gap = np.subtract.outer(c[a], c[b])
            gap *= gap
            d += gap
        if self.radius > EARTH_M / 100:
            d = 2 * EARTH_M * np.arcsin(np.minimum(np.sqrt(d) / (2 * EARTH_M), 1.0))
        else:  # the next term of the arc is below 1e-9 of it
            arc = np.sqrt(d)
            d *= arc
            d *= 1 / (24 * EARTH_M**2)
            d += arc
        i, j = np.nonzero(np.abs(d - self.radius) <= EVEN_M)
        fit = haversine_np(self.lat[a[i]], self.lon[a[i]], self.lat[b[j]], self.lon[b[j]]) <= self.radius
        d[d > self.radius] = np.inf
        d[i, j] = np.where(fit, self.radius, np.inf)
        return d


def _settle(m: Metres, best: np.ndarray, front: np.ndarray) -> np.ndarray:
    """Relaxes the points in front, those at the least distances first, until none is left; which points came nearer."""
    changed = np.zeros(len(best), bool)
    while front.any():
        low = best[front].min()
        rows = np.flatnonzero(front & (best <= low + m.radius / 4))
        front[rows] = False
        for a, b in m.groups(rows):
            b = b[best[b] > low]
            step = max(1, CANDIDATES // max(1, len(b)))
            for s in range(0, len(a) if len(b) else 0, step):
                d = m.apart(a[s : s + step], b)
                d += best[a[s : s + step], None]
                offer = d.min(axis=0)
                better = offer < best[b] - 1e-9
                best[b[better]] = offer[better]
                front[b[better]] = changed[b[better]] = True
    return changed


def shortest_paths_within(points: DataFrame, source: int, radius_m: float, rows: int = TILE_ROWS) -> DataFrame:
    """(id, distance): least length of a path from the source to every point it reaches by steps of at most ``radius_m``.

    In each round the tiles that were told of nearer points settle their own and tell the tiles around of what changed, until nothing
    changes. Only what changed is kept of a round.
    """
    known = cut(_with_place(points))
    reach = Reach(known, radius_m, rows)
    spark, schema = points.sparkSession, "turn int, tile int, id long, lat double, lon double, distance double, home boolean"
    kinds = ("turn", "tile", "id", "lat", "lon", "distance", "home")

    def told(turn: int, ids: np.ndarray, lat: np.ndarray, lon: np.ndarray, distance: np.ndarray) -> pa.Table:
        tile, point, home = reach.of(lat, lon)
        return pa.table(dict(zip(kinds, (pa.array(np.full(len(tile), turn, np.int32)), pa.array(tile), ids[point], lat[point], lon[point], distance[point], pa.array(home)))))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tile = reach.grid.of(b["lon"].to_numpy(), b["lat"].to_numpy())
            n = len(tile)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), pa.array(tile), b["id"], b["lat"], b["lon"], pa.array(np.full(n, np.inf)), pa.array(np.ones(n, bool))], kinds)

    static = cut(known.mapInArrow(own, schema))
    start = known.where(F.col("id") == source).select("id", "lat", "lon").toPandas()
    first = told(0, *(start[c].to_numpy() for c in ("id", "lat", "lon")), np.zeros(len(start)))
    log = [spark.createDataFrame(first, schema)]
    for turn in range(1, 2**31 - 1):
        active = log[-1].select("tile").distinct()

        def one(t: pa.Table) -> pa.Table:  # sent off before the turn moves on
            turns, ids, lat, lon, distance, home = (t[c].to_numpy() for c in ("turn", "id", "lat", "lon", "distance", "home"))
            at = np.flatnonzero(home & (turns < 0))
            order = at[np.argsort(ids[at])]
            news = np.flatnonzero((turns == turn - 1) & (~home | (turn == 1)))
            m = Metres(np.append(lat[order], lat[news]), np.append(lon[order], lon[news]), radius_m)
            best = np.full(len(order) + len(news), -np.inf)  # points of other tiles are only sources here
            best[: len(order)] = np.inf
            known = np.flatnonzero(home & (turns >= 0))
            np.minimum.at(best, np.searchsorted(ids[order], ids[known]), distance[known])
            changed = np.zeros(len(order), bool)
            offers, front = distance[news], np.zeros(len(best), bool)
            for a, b in m.groups(np.arange(len(order), len(best))):
                b = b[b < len(order)]
                b = b[best[b] > offers[a - len(order)].min()]
                step = max(1, CANDIDATES // max(1, len(b)))
                for s in range(0, len(a) if len(b) else 0, step):
                    offer = (m.apart(a[s : s + step], b) + offers[a[s : s + step] - len(order), None]).min(axis=0)
                    better = offer < best[b] - 1e-9
                    best[b[better]] = offer[better]
                    front[b[better]] = changed[b[better]] = True
            changed |= _settle(m, best, front)[: len(order)]
            c = np.flatnonzero(changed)
            return told(turn, ids[order][c], lat[order][c], lon[order][c], best[c])

        seen = reduce(DataFrame.unionByName, [static, *log]).join(F.broadcast(active), "tile", "left_semi").select(*kinds)  # as many as tiles at most
        log.append(cut(seen.groupBy("tile").applyInArrow(one, schema)))
        if log[-1].isEmpty():
            found = reduce(DataFrame.unionByName, log).where("home").groupBy("id").agg(F.min("distance").alias("distance"))
            alone = spark.createDataFrame([(source, 0.0)], "id long, distance double")
            return found if len(start) else alone


def links_within(points: DataFrame, radius_m: float, rows: int = TILE_ROWS) -> DataFrame:
    """(id, links): how many others are at most ``radius_m`` away, for points with a position."""

    def one(t: pa.Table) -> pa.Table:
        ids, lat, lon, home = (t[c].to_numpy() for c in ("id", "lat", "lon", "home"))
        m, n = Metres(lat, lon, radius_m), np.zeros(len(ids), np.int64)
        for a, b in m.groups(np.flatnonzero(home)):
            step = max(1, CANDIDATES // len(b))
            for s in range(0, len(a), step):
                n[a[s : s + step]] = np.isfinite(m.apart(a[s : s + step], b)).sum(axis=1) - 1
        return pa.table({"id": ids[home], "links": n[home]})

    return tiled(points, radius_m, rows).groupBy("tile").applyInArrow(one, "id long, links long")


def corridors_within(points: DataFrame, radius_m: float, density: DataFrame, rows: int = TILE_ROWS, **asked) -> DataFrame:
    """``corridors`` of the graph of points at most ``radius_m`` apart."""
    made = forest(points, radius_m, rows)
    labels = cut(components_within(points, radius_m, made))
    links = links_within(points, radius_m, rows).join(labels, "id").groupBy("component").agg((F.sum("links") / 2).cast("long").alias("links")).where("links > 0")
    return corridors_of(points, labels, links, spanning_tree_within(points, radius_m, made), density, **asked)
