"""Points near other points, and the regions that contain points.

Radius join: a two-level Voronoi partition around pivots. A point's home is its nearest pivot; by the triangle inequality
it can have a neighbour within r in another cell only if that cell's pivot is at most 2r further away than its own, so it
is sent there too, and only to cells of lower number, which finds each pair once. In each cell a vantage-point tree under
the great-circle metric lists the pairs. Pivots are a sample of bounded size; they steer the load, never the result.
Positions shared by very many rows are joined once as a position and spread out afterwards over blocks of rows.

Regions: each point is tested against the polygons whose box holds it. A region table within ``MAX_REGIONS`` and
``MAX_VERTICES`` is sent to all tasks; a larger one is met by an equi-join on grid cells.

Defined cases: rows without an id or a position take no part; equal positions are 0 m apart and pair up; a point on an outer
ring or on the rim of a hole lies in the region; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.common import by_group, skew_join
from terravane.functions.geo import arc_m, haversine_np, in_polygon, polygons, unit

CELL_ROWS = 2_000
MAX_PIVOTS = 65_536
LEAF = 48
SLICE, QUERIES = 1_000_000, 20_000
HOT_SHARE, HOT_ROWS = 1e-5, 1_024
MAX_REGIONS, MAX_VERTICES = 4_096, 500_000
SLACK_M = 1e-3  # pruning keeps this much more than the radius; the exact test follows

PAIRS = "a long, b long, a_hot boolean, b_hot boolean"


class Pivots:
    """Pivots in two levels: about sqrt(n) groups, each with its own members."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray) -> None:
        u = unit(lat, lon)
        k = max(1, int(np.sqrt(len(u))))
        self.top = u[:k]
        owner = np.argmax(u @ self.top.T, axis=1)
        self.members = [u[owner == i] for i in range(k)]
        self.first = np.cumsum([0] + [len(m) for m in self.members])

    @staticmethod
    def _reach(u: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and pivots at most 2r further than the nearest pivot, and whether it is the nearest."""
        d = arc_m(np.sqrt(np.maximum(0.0, 2 - 2 * (u @ pivots.T))))
        best = d.argmin(axis=1)
        # the chord from a dot product is good to about a metre near zero; allow for it
        row, col = np.nonzero(d <= d[np.arange(len(u)), best][:, None] + 2 * r + 2.0)
        return row, col, best[row] == col

    def assign(self, u: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, is home) for every cell that a row has to be in."""
        rows, cells, homes = [], [], []
        row1, top, near1 = self._reach(u, self.top, r)
        order = np.argsort(top, kind="stable")
        row1, top, near1 = row1[order], top[order], near1[order]
        cuts = np.searchsorted(top, np.arange(len(self.top) + 1))
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            if lo == hi or not len(self.members[i]):
                continue
            row2, sub, near2 = self._reach(u[row1[lo:hi]], self.members[i], r)
            rows.append(row1[lo:hi][row2])
            cells.append(self.first[i] + sub)
            homes.append(near1[lo:hi][row2] & near2)
        if not rows:
            return np.empty(0, int), np.empty(0, int), np.empty(0, bool)
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


def vp_pairs(u: np.ndarray, queries: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate (query, point) index pairs within r metres, by a vantage-point tree that all queries go down together."""
    left, right = [], []
    stack = [(np.arange(len(u)), queries)]
    limit = 2 * np.sin((r + SLACK_M) / (2 * 6_371_008.8)) + 1e-12
    while stack:
        pts, qs = stack.pop()
        if not len(qs):
            continue
        far = None
        if len(pts) > LEAF:
            away = arc_m(np.sqrt(((u[pts] - u[pts[0]]) ** 2).sum(axis=1)))
            vantage = u[pts[away.argmax()]]
            d = arc_m(np.sqrt(((u[pts] - vantage) ** 2).sum(axis=1)))
            mu = np.partition(d, len(d) // 2)[len(d) // 2]
            far = d > mu
            if not far.any():
                far = d >= mu
                mu = np.nextafter(mu, -np.inf)
        if far is None or far.all():
            step = max(1, 4_000_000 // max(1, len(pts)))
            for s in range(0, len(qs), step):
                q = qs[s : s + step]
                gap = u[q][:, None, :] - u[pts][None, :, :]
                i, j = np.nonzero(np.einsum("ijk,ijk->ij", gap, gap) <= limit * limit)
                left.append(q[i])
                right.append(pts[j])
            continue
        dq = arc_m(np.sqrt(((u[qs] - vantage) ** 2).sum(axis=1)))
        stack.append((pts[~far], qs[dq <= mu + r + SLACK_M]))
        stack.append((pts[far], qs[dq >= mu - r - SLACK_M]))
    if not left:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(left), np.concatenate(right)


def _spread(starts: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (row, row) indices of the given group pairs, groups being runs of sorted rows, at most about ``most`` at once."""
    a, na, b, nb = starts[i], sizes[i], starts[j], sizes[j]
    rows = np.maximum(1, most // nb)  # of the left group in one slice
    parts = -(-na // rows)
    if (parts > 1).any():
        pair = np.repeat(np.arange(len(a)), parts)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        a, na, b, nb = a[pair] + k * rows[pair], np.minimum(rows[pair], na[pair] - k * rows[pair]), b[pair], nb[pair]
    n = na * nb
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + most, side="right")))
        m = n[at:to]
        pair = np.repeat(np.arange(at, to), m)
        k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield a[pair] + k // nb[pair], b[pair] + k % nb[pair]
        at = to


def _cell_pairs(t: pa.Table, r: float) -> Iterator[pa.RecordBatch]:
    """The pairs of one cell, slice by slice: home positions look for their neighbours QUERIES at a time."""
    lat, lon = t["lat"].to_numpy(), t["lon"].to_numpy()
    ids, home, hot = t["id"].to_numpy(), t["home"].to_numpy(), t["hot"].to_numpy()
    order = np.lexsort((ids, lon, lat, ~home))
    lat, lon, ids, home, hot = lat[order], lon[order], ids[order], home[order], hot[order]
    new = np.ones(len(ids), bool)
    new[1:] = (lat[1:] != lat[:-1]) | (lon[1:] != lon[:-1]) | (home[1:] != home[:-1])
    starts, same = np.flatnonzero(new), new.cumsum()
    sizes = np.diff(np.append(starts, len(ids)))
    plat, plon, phome = lat[starts], lon[starts], home[starts]
    u, asking = unit(plat, plon), np.flatnonzero(phome)
    for s in range(0, len(asking), QUERIES):
        i, j = vp_pairs(u, asking[s : s + QUERIES], r)
        keep = (i <= j) | ~phome[j]
        i, j = i[keep], j[keep]
        keep = haversine_np(plat[i], plon[i], plat[j], plon[j]) <= r
        for a, b in _spread(starts, sizes, i[keep], j[keep]):
            keep = (ids[a] != ids[b]) & ((same[a] != same[b]) | (ids[a] < ids[b]))
            a, b = a[keep], b[keep]
            flip = ids[a] > ids[b]
            a, b = np.where(flip, b, a), np.where(flip, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(hot[a]), pa.array(hot[b])], ["a", "b", "a_hot", "b_hot"])


def near_pairs(points: DataFrame, radius_m: float, cell_rows: int = CELL_ROWS, hot_rows: int = HOT_ROWS, max_pivots: int = MAX_PIVOTS, at_most: int | None = None) -> DataFrame:
    """(key_a, key_b): ids of all pairs of rows at most ``radius_m`` apart, the smaller id first. points: (id long, lat, lon), ids unique.

    One job runs at once: it brings the pivots (one position in ``cell_rows``, about ``max_pivots`` at most) and the
    positions that hold more than ``hot_rows`` rows and a share of HOT_SHARE of all (at most 1/HOT_SHARE of them).
    ``at_most`` is a known upper bound of the number of rows, which saves counting them.
    """
    spark = points.sparkSession
    points = points.where(F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    places = points.groupBy("lat", "lon").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    total = points.count() if at_most is None else at_most
    every = max(cell_rows, total // max_pivots + 1)
    is_hot = F.col("n") > max(hot_rows, total * HOT_SHARE)
    chosen = places.where(is_hot | (F.pmod(F.xxhash64("lat", "lon"), F.lit(every)) == 0)).select("lat", "lon", "rep", is_hot.alias("hot")).toPandas()
    chosen = chosen.sort_values(["lat", "lon"]).sample(frac=1, random_state=7)
    hot = chosen[chosen["hot"]]
    seeds = chosen[~chosen["hot"]][:max_pivots] if (~chosen["hot"]).any() else chosen[:1]
    at = seeds[["lat", "lon"]].to_numpy(float) if len(seeds) else np.zeros((1, 2))
    pivots = Pivots(at[:, 0], at[:, 1])

    rows = points.select("id", "lat", "lon", F.lit(False).alias("hot"))
    if len(hot):
        known = F.broadcast(spark.createDataFrame(hot[["lat", "lon", "rep"]], "lat double, lon double, rep long"))
        tied = points.join(known, ["lat", "lon"], "left")
        rows = tied.where("rep is null").select("id", "lat", "lon", F.lit(False).alias("hot")).unionByName(known.select(F.col("rep").alias("id"), "lat", "lon", F.lit(True).alias("hot")))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = unit(b["lat"].to_numpy(), b["lon"].to_numpy())
            row, cell, home = pivots.assign(u, radius_m)
            own = np.full(b.num_rows, -1)
            own[row[home]] = cell[home]
            keep = home | (cell < own[row])
            row, cell, home = row[keep], cell[keep], home[keep]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b["id"].take(take), b["lat"].take(take), b["lon"].take(take), b["hot"].take(take), pa.array(home)], ["cell", "id", "lat", "lon", "hot", "home"])

    placed = rows.mapInArrow(assign, "cell int, id long, lat double, lon double, hot boolean, home boolean")
    pairs = placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(by_group(["cell"], lambda t: _cell_pairs(t, radius_m)), PAIRS)
    if not len(hot):
        return pairs.select(F.col("a").alias("key_a"), F.col("b").alias("key_b"))
    return _expand(pairs, tied.where("rep is not null").select("rep", "id"))


def _expand(pairs: DataFrame, members: DataFrame, block: int = 4_096) -> DataFrame:
    """Pairs of hot positions spread out to their rows, and the rows of each hot position among themselves, block by block."""
    ordered = lambda a, b: (F.least(a, b).alias("key_a"), F.greatest(a, b).alias("key_b"))
    plain = pairs.where(~F.col("a_hot") & ~F.col("b_hot")).select(*ordered(F.col("a"), F.col("b")))
    left = pairs.where("a_hot or b_hot").select(F.when(F.col("a_hot"), F.col("a")).otherwise(F.col("b")).alias("rep"), F.when(F.col("a_hot"), F.col("b")).otherwise(F.col("a")).alias("other"), (F.col("a_hot") & F.col("b_hot")).alias("both"))
    once = skew_join(members, left, ["rep"], "inner", F.col("id"))
    single = once.where(~F.col("both")).select(*ordered(F.col("id"), F.col("other")))
    twice = skew_join(once.where("both").select(F.col("id").alias("x"), F.col("other").alias("rep")), members, ["rep"], "inner", F.col("x")).select(*ordered(F.col("x"), F.col("id")))
    sizes = members.groupBy("rep").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("blocks"))
    cut = members.join(F.broadcast(sizes), "rep").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))  # at most 1/HOT_SHARE rows
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    a = cut.select("rep", "id", F.col("blk").alias("i"), F.explode(every).alias("j"))
    b = cut.select("rep", F.col("id").alias("id2"), F.col("blk").alias("j"), F.explode(every).alias("i"))
    own = a.join(b, ["rep", "i", "j"]).where(F.col("id") < F.col("id2")).select(F.col("id").alias("key_a"), F.col("id2").alias("key_b"))
    return plain.unionByName(single).unionByName(twice).unionByName(own)


class Shapes:
    """Polygons by the cells of a grid their boxes touch, about as many cells as polygons."""

    def __init__(self, shapes: list[tuple[int, list[np.ndarray]]]) -> None:
        self.shapes = shapes
        boxes = np.array([[*rings[0].min(axis=0), *rings[0].max(axis=0)] for _, rings in shapes]).reshape(-1, 4)
        self.boxes, self.cells = boxes, {}
        if not len(boxes):
            return
        self.low, self.side = boxes[:, :2].min(axis=0), max(1, int(np.ceil(np.sqrt(len(boxes)))))
        self.step = np.maximum((boxes[:, 2:].max(axis=0) - self.low) / self.side, 1e-12)
        spans = np.clip(((boxes.reshape(-1, 2, 2) - self.low) / self.step).astype(int), 0, self.side - 1)
        for k, ((i0, j0), (i1, j1)) in enumerate(spans):
            for i in range(i0, i1 + 1):
                for j in range(j0, j1 + 1):
                    self.cells.setdefault(i * self.side + j, []).append(k)

    def holding(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[list, list]:
        """(point ids, region ids) in parts."""
        points, regions = [], []
        if not self.cells:
            return points, regions
        at = np.floor((np.stack([x, y], axis=1) - self.low) / self.step).astype(int)
        near = np.flatnonzero(((at >= 0) & (at <= self.side)).all(axis=1))
        code = np.minimum(at[near], self.side - 1) @ np.array([self.side, 1])
        order = np.argsort(code, kind="stable")
        near, code = near[order], code[order]
        edge = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, int)
        for lo, hi in zip(edge, np.append(edge[1:], len(code))):
            for k in self.cells.get(int(code[lo]), ()):
                x0, y0, x1, y1 = self.boxes[k]
                rows = near[lo:hi]
                rows = rows[(x[rows] >= x0) & (x[rows] <= x1) & (y[rows] >= y0) & (y[rows] <= y1)]
                if len(rows):
                    region, rings = self.shapes[k]
                    rows = rows[in_polygon(x[rows], y[rows], rings)]
                    points.append(ids[rows])
                    regions.append(np.full(len(rows), region))
        return points, regions


def containing(points: DataFrame, regions: DataFrame, max_regions: int = MAX_REGIONS, max_vertices: int = MAX_VERTICES, cell_deg: float = 1.0, fan: int = 16) -> DataFrame:
    """(key_a point id, key_b region id), once each. points: (id, lat, lon); regions: (region_id long, geojson string), plane lon/lat."""
    schema = "key_a long, key_b long"

    def pairs(ids: np.ndarray, x: np.ndarray, y: np.ndarray, shapes: Shapes) -> pa.RecordBatch:
        p, r = shapes.holding(ids, x, y)
        both = np.unique(np.stack([np.concatenate(p), np.concatenate(r)], axis=1), axis=0) if p else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], ["key_a", "key_b"])

    points = points.where(F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    size = regions.agg(F.count("*").alias("n"), F.sum(F.length("geojson")).alias("c")).first()
    if size["n"] <= max_regions and (size["c"] or 0) <= max_vertices * 20:
        shapes = Shapes([(r["region_id"], p) for r in regions.select("region_id", "geojson").collect() if r["region_id"] is not None for p in polygons(r["geojson"])])

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pairs(b["id"].to_numpy(), b["lon"].to_numpy(), b["lat"].to_numpy(), shapes)

        return points.select("id", "lat", "lon").mapInArrow(test, schema)

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for region, text in zip(b["region_id"].to_pylist(), b["geojson"].to_pylist()):
                for rings in polygons(text):
                    (x0, y0), (x1, y1) = np.floor(rings[0].min(axis=0) / cell_deg).astype(int), np.floor(rings[0].max(axis=0) / cell_deg).astype(int)
                    out |= {(region, text, int(i), int(j)) for i in range(x0, x1 + 1) for j in range(y0, y1 + 1) if region is not None}
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["region_id", "geojson", "cx", "cy"])

    cells = regions.select(F.col("region_id").cast("long").alias("region_id"), "geojson").mapInArrow(boxed, "region_id long, geojson string, cx int, cy int")
    here = points.select("id", "lat", "lon", F.floor(F.col("lon") / cell_deg).cast("int").alias("cx"), F.floor(F.col("lat") / cell_deg).cast("int").alias("cy"))
    here = here.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(fan)).cast("int"))
    cells = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))))

    def meet(p: pa.Table, r: pa.Table) -> pa.Table:
        shapes = Shapes([(k, poly) for k, text in zip(r["region_id"].to_pylist(), r["geojson"].to_pylist()) for poly in polygons(text)])
        return pa.Table.from_batches([pairs(p["id"].to_numpy(), p["lon"].to_numpy(), p["lat"].to_numpy(), shapes)])

    keys = ["cx", "cy", "salt"]
    return here.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(meet, schema).distinct()
