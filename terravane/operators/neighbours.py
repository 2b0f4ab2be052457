"""Exact k nearest neighbours in the plane, density, residuals, LOF and DBSCAN on the neighbour list.

Points are cut into tiles of about equal numbers (strips along x, cut along y). Each tile finds the k nearest of its own
points, which bounds the k-th distance from above; a point whose ball of that radius leaves its tile is also asked of the
tiles it reaches, and the k best of all answers are kept. The result is exact and depends on no grid size. Ties are broken by
the smaller id; a point is never its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions.stats import quantile
from terravane.operators.cleaning import robust_scale
from terravane.operators.featurespace import neighbour_list
from terravane.operators.graph import components
from terravane.operators.ranking import ordinal01
from terravane.session import cut

TILE_ROWS = 1_500
MAX_CUTS = 1_024
EDGES = "i long, j long, d double"
NODES = 32


class Tiles:
    """Strips along x, each cut along y; the cuts, at most MAX_CUTS squared of them, come to the driver and find a tile by search."""

    def __init__(self, xs: np.ndarray, ys: list[np.ndarray]) -> None:
        self.xs, self.ys = xs, ys
        self.first = np.cumsum([0] + [len(y) + 1 for y in ys])

    @property
    def count(self) -> int:
        return int(self.first[-1])

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        strip, out = np.searchsorted(self.xs, x, side="right"), np.zeros(len(x), np.int32)
        for s in np.unique(strip):
            at = np.flatnonzero(strip == s)
            out[at] = self.first[s] + np.searchsorted(self.ys[s], y[at], side="right")
        return out

    def reached(self, x: np.ndarray, y: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tile, point) of every tile that a square of half side ``far`` around a point touches."""
        low, high = np.searchsorted(self.xs, x - far, side="right"), np.searchsorted(self.xs, x + far, side="right")
        tile, point = [], []
        for s in range(int(low.min()), int(high.max()) + 1) if len(x) else ():
            at = np.flatnonzero((low <= s) & (s <= high))
            a, b = np.searchsorted(self.ys[s], y[at] - far[at], side="right"), np.searchsorted(self.ys[s], y[at] + far[at], side="right")
            n = b - a + 1
            tile.append(self.first[s] + np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            point.append(np.repeat(at, n))
        return (np.concatenate(tile), np.concatenate(point)) if tile else (np.empty(0, int), np.empty(0, int))


def tiles(points: DataFrame, rows: int = TILE_ROWS) -> Tiles:
    n = points.count()
    side = int(min(MAX_CUTS, max(1, np.sqrt(n / rows))))
    if side <= 1:
        return Tiles(np.empty(0), [np.empty(0)])
    qs = F.array(*[F.lit(i / side) for i in range(1, side)])
    xs = np.array(sorted(set(points.agg(F.percentile_approx("x", qs, F.lit(10_000))).first()[0])))
    known = np.asarray(xs).tolist()

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(known, b["x"].to_numpy(), side="right").astype(np.int32)), b["y"]], ["s", "y"])

    cuts = points.select("x", "y").mapInArrow(strips, "s int, y double").groupBy("s").agg(F.percentile_approx("y", qs, F.lit(10_000)).alias("q")).collect()
    by_strip = {r["s"]: np.array(sorted(set(r["q"]))) for r in cuts}
    return Tiles(xs, [by_strip.get(s, np.empty(0)) for s in range(len(xs) + 1)])


def _best(qx, qy, qid, px, py, pid, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, squared distance) of the k nearest other points, by (distance, id); queries in blocks."""
    qi, ids, ds = [], [], []
    step = max(1, 2_000_000 // max(1, len(px)))
    for s in range(0, len(qx), step):
        d2 = (qx[s : s + step, None] - px[None, :]) ** 2 + (qy[s : s + step, None] - py[None, :]) ** 2
        d2[qid[s : s + step, None] == pid[None, :]] = np.inf
        kk = min(k, d2.shape[1])
        bound = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
        r, c = np.nonzero((d2 <= bound[:, None]) & np.isfinite(d2))
        v = d2[r, c]
        order = np.lexsort((pid[c], v, r))
        r, c, v = r[order], c[order], v[order]
        first = np.searchsorted(r, np.arange(len(d2)))
        keep = np.arange(len(r)) - first[r] < k
        qi.append(r[keep] + s)
        ids.append(pid[c[keep]])
        ds.append(v[keep])
    return np.concatenate(qi), np.concatenate(ids), np.concatenate(ds)


def knn(points: DataFrame, k: int, rows: int = TILE_ROWS, asks: str | None = None) -> DataFrame:
    """(i, j, d, rank): the k nearest others of every point, or of those where the column ``asks`` is true. points: (id long, x, y); rows with a missing or infinite coordinate take no part."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    points = points.where(finite("x") & finite("y")).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col(asks) if asks else F.lit(True)).alias("asks"))
    grid = tiles(points, rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield pa.RecordBatch.from_arrays([pa.array(grid.of(t["x"].to_numpy(), t["y"].to_numpy())), t["id"], t["x"], t["y"], t["asks"]], ["tile", "id", "x", "y", "asks"])

    placed = points.mapInArrow(place, "tile int, id long, x double, y double, asks boolean")

    def inside(t: pa.Table) -> pa.Table:
        x, y, ids, n = t["x"].to_numpy(), t["y"].to_numpy(), t["id"].to_numpy(), t["tile"][0].as_py()
        own = np.flatnonzero(t["asks"].to_numpy())
        if not len(own):
            return pa.table({"ask": pa.array([], pa.int32()), "i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("d2", "x", "y")}})
        q, j, d2 = _best(x[own], y[own], ids[own], x, y, ids, k)
        x, y, ids = x[own], y[own], ids[own]
        counts = np.bincount(q, minlength=len(x))
        far = np.full(len(x), np.inf)
        full = counts >= k
        last = np.cumsum(counts) - 1
        far[full] = np.sqrt(d2[last[full]]) * (1 + 1e-9)
        to, at = grid.reached(x, y, far)
        to, at = to[to != n], at[to != n]
        found, sent = len(q), len(at)
        none_i, none_f = np.full(sent, -1, np.int64), np.zeros(sent)
        return pa.table({
            "ask": pa.array(np.concatenate([np.full(found, -1), to]), pa.int32()), "i": np.concatenate([ids[q], ids[at]]), "j": np.concatenate([j, none_i]),
            "d2": np.concatenate([d2, none_f]), "x": np.concatenate([np.zeros(found), x[at]]), "y": np.concatenate([np.zeros(found), y[at]]),
        })

    first = placed.groupBy("tile").applyInArrow(inside, "ask int, i long, j long, d2 double, x double, y double")
    if grid.count == 1:
        return _ranked(first.select("i", "j", "d2"), k)

    def outside(q: pa.Table, p: pa.Table) -> pa.Table:
        if not q.num_rows or not p.num_rows:
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "d2": pa.array([], pa.float64())})
        qi, j, d2 = _best(q["x"].to_numpy(), q["y"].to_numpy(), q["i"].to_numpy(), p["x"].to_numpy(), p["y"].to_numpy(), p["id"].to_numpy(), k)
        return pa.table({"i": q["i"].to_numpy()[qi], "j": j, "d2": d2})

    asked = first.where("ask >= 0").select(F.col("ask").alias("tile"), "i", "x", "y")
    more = asked.groupBy("tile").cogroup(placed.groupBy("tile")).applyInArrow(outside, "i long, j long, d2 double")
    return _ranked(first.where("ask < 0").select("i", "j", "d2").unionByName(more), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("i").orderBy("d2", "j")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("i", "j", F.sqrt("d2").alias("d"), "rank")


def density(edges: DataFrame, k: int) -> DataFrame:
    """(id, radius, density, density_rank) from the distance to the k-th neighbour."""
    far = edges.groupBy(F.col("i").alias("id")).agg(F.greatest(F.max("d"), F.lit(1e-9)).alias("radius"), F.count("*").alias("k"))
    return ordinal01(far.withColumn("density", F.col("k") / (F.lit(np.pi) * F.col("radius") * F.col("radius"))), "density", "id", "density_rank").drop("k")


def neighbour_mean(edges: DataFrame, values: DataFrame, value: str, out: str) -> DataFrame:
    v = values.select(F.col("id").alias("j"), F.col(value).alias("__v"))
    return edges.join(v, "j").groupBy(F.col("i").alias("id")).agg(F.avg("__v").alias(out))


def lof(edges: DataFrame) -> DataFrame:
    """(id, lof): local outlier factor of the points of a k-nearest-neighbour list (Breunig et al. 2000)."""
    reach_of = edges.groupBy("i").agg(F.max("d").alias("kd"))
    lrd = edges.join(reach_of.select(F.col("i").alias("j"), "kd"), "j").groupBy("i").agg((1 / (F.avg(F.greatest("kd", "d")) + 1e-10)).alias("lrd"))
    near = edges.join(lrd.select(F.col("i").alias("j"), F.col("lrd").alias("lrd_j")), "j").groupBy("i").agg(F.avg("lrd_j").alias("near"))
    return near.join(lrd, "i").select(F.col("i").alias("id"), (F.col("near") / F.col("lrd")).alias("lof"))


def lof_with_value(points: DataFrame, value: str, k: int) -> DataFrame:
    """(id, lof): local outlier factor over position and value, each scaled by its median and quartile range; points: (id, x, y, value)."""
    columns = ["x", "y", value]
    scaled = robust_scale(points.select("id", *columns), columns, "__z")
    rows, edges = neighbour_list(scaled, [f"{c}__z" for c in columns], k)
    if edges is None:
        return rows.select("id", F.lit(None).cast("double").alias("lof"))
    edges = cut(edges)
    f, g = ["f0", "f1", "f2"], ["g0", "g1", "g2"]
    reach = edges.groupBy(*f).agg(F.max("d").alias("kd")).select(*[F.col(a).alias(b) for a, b in zip(f, g)], "kd")
    mean = lambda c: F.sum(c * F.col("n")) / F.sum("n")
    lrd = cut(edges.join(reach, g).groupBy(*f).agg((1 / (mean(F.greatest("kd", "d")) + 1e-10)).alias("lrd")))
    around = edges.join(lrd.select(*[F.col(a).alias(b) for a, b in zip(f, g)], F.col("lrd").alias("other")), g).groupBy(*f).agg(mean(F.col("other")).alias("near"))
    return rows.join(around.join(lrd, f).select(*f, (F.col("near") / F.col("lrd")).alias("lof")), f, "left").select("id", "lof")


def proximity_clusters(points: DataFrame, edges: DataFrame, k: int, times: float = 2.5) -> DataFrame:
    """DBSCAN with a radius of ``times`` the median distance to the nearest neighbour, and 4 to 12 points to a core."""
    nearest = edges.where("rank = 1").agg(quantile(F.col("d"), 0.5).alias("m")).first()["m"] or 0.0
    return dbscan(points, max(times * nearest, 1e-9), max(4, min(12, k)))


def within(points: DataFrame, radius: float) -> DataFrame:
    """(i, j, d) with i < j and d <= radius, by an equi-join on square cells of the radius: each point goes to its own cell and is met by the half of the cells around it."""
    c = points.select("id", "x", "y", F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    half = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    sent = c.withColumn("o", F.explode(half)).select(F.col("id").alias("id1"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"), ((F.col("o.a") == 0) & (F.col("o.b") == 0)).alias("own"))
    d = F.sqrt(F.pow(F.col("x1") - F.col("x"), 2) + F.pow(F.col("y1") - F.col("y"), 2))
    met = sent.join(c, ["cx", "cy"]).where(~F.col("own") | (F.col("id1") < F.col("id"))).withColumn("d", d).where(F.col("d") <= radius)
    return met.select(F.least("id1", "id").alias("i"), F.greatest("id1", "id").alias("j"), "d")


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster): the smallest core id of the cluster, -1 for noise; a border point joins the reachable cluster of the smallest id."""
    edges = within(points, eps)
    both = edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
    core = both.groupBy("i").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= min_samples).select(F.col("i").alias("id"))
    if min_samples <= 1:
        core = points.select("id")
    links = both.join(core.select(F.col("id").alias("i")), "i", "left_semi").join(core.select(F.col("id").alias("j")), "j", "left_semi").where("i < j")
    label = components(core, links.select(F.col("i").alias("src"), F.col("j").alias("dst"))).select("id", F.col("component").alias("cluster"))
    border = both.join(label.select(F.col("id").alias("j"), "cluster"), "j").groupBy(F.col("i").alias("id")).agg(F.min("cluster").alias("near"))
    out = points.select("id").join(label, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("cluster", "near", F.lit(-1).cast("long")).alias("cluster"))


def _chebyshev(half: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of barycentric interpolation on -half..half."""
    turn = (2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)
    return half * np.cos(turn), (-1.0) ** np.arange(NODES) * np.sin(turn)


def _interpolated(x: np.ndarray, nodes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Matrix that takes values at the nodes to values at x."""
    gap = x[:, None] - nodes
    exact = gap == 0
    part = w / np.where(exact, 1.0, gap)
    hit = exact.any(axis=1)
    part[hit] = exact[hit]
    return part / part.sum(axis=1, keepdims=True)


def kde(points: DataFrame, bandwidth: float, weight: Column | None = None, reach: float = 6.0) -> DataFrame:
    """(id, density): Gaussian kernel density at each point; a kernel is followed to at least ``reach`` bandwidths, where it is below 2e-8 of its peak.

    Points are in squares of four bandwidths. The kernel is smooth there, so the points of a full square act as weights on NODES x NODES
    Chebyshev places, and the field on a full square is made at such places and interpolated, both to about 1e-13 of the peak; other
    squares are summed point by point. So the work grows with the points and not with their pairs.
    """
    side, around = 4 * bandwidth, int(np.ceil(reach / 4))
    nodes, bary = _chebyshev(side / 2)
    w = points.withColumn("w", F.coalesce(weight, F.lit(1.0)) if weight is not None else F.lit(1.0)).withColumn("w", F.col("w").cast("double"))
    total = w.agg(F.sum("w").alias("t"))
    placed = F.lit(True)
    for c in ("x", "y"):
        placed = placed & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    cell = lambda c: F.floor(F.col(c) / side)
    inner = lambda c: (F.col(c) - (F.floor(F.col(c) / side) + 0.5) * side)
    own = w.where(placed).select(cell("x").alias("cx"), cell("y").alias("cy"), "id", inner("x").cast("double").alias("x"), inner("y").cast("double").alias("y"), "w")

    def gather(t: pa.Table) -> pa.Table:
        x, y, v = (t[c].to_numpy() for c in ("x", "y", "w"))
        if len(x) > NODES * NODES:
            grid = np.zeros((NODES, NODES))
            for s in range(0, len(x), 65_536):
                at = slice(s, s + 65_536)
                grid += (_interpolated(x[at], nodes, bary) * v[at, None]).T @ _interpolated(y[at], nodes, bary)
            x, y, v = x[:0], y[:0], grid.ravel()
        lists = pa.list_(pa.float64())
        return pa.table({"cx": t["cx"][:1], "cy": t["cy"][:1], "xs": pa.array([x.tolist()], lists), "ys": pa.array([y.tolist()], lists), "ws": pa.array([v.tolist()], lists)})

    sources = own.groupBy("cx", "cy").applyInArrow(gather, "cx long, cy long, xs array<double>, ys array<double>, ws array<double>")
    step = F.sequence(F.lit(-around), F.lit(around))
    sent = sources.select("*", F.explode(step).alias("dx")).select("*", F.explode(step).alias("dy"))
    sent = sent.select((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), "dx", "dy", "xs", "ys", "ws")

    def bell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-((a[:, None] - b) ** 2) / (2 * bandwidth * bandwidth))

    def field(t: pa.Table, s: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        x, y = t["x"].to_numpy(), t["y"].to_numpy()
        full, grid, out = len(x) > NODES * NODES, np.zeros((NODES, NODES)), np.zeros(len(x))
        for k in range(s.num_rows):
            xs, ys, ws = (np.asarray(s[c][k].values) for c in ("xs", "ys", "ws"))
            spread = not len(xs)  # weights on the places of its square
            xs, ys = (nodes if spread else v for v in (xs, ys))
            xs, ys = xs - s["dx"][k].as_py() * side, ys - s["dy"][k].as_py() * side
            ws = ws.reshape(NODES, NODES) if spread else ws
            if full:
                a = bell(nodes, xs)
                grid += (a @ ws if spread else a * ws) @ bell(ys, nodes)
            elif spread:
                out += ((bell(x, xs) @ ws) * bell(y, ys)).sum(axis=1)
            else:
                out += (bell(x, xs) * bell(y, ys)) @ ws
        for at in range(0, len(x) if full else 0, 65_536):
            part = slice(at, at + 65_536)
            out[part] = ((_interpolated(x[part], nodes, bary) @ grid) * _interpolated(y[part], nodes, bary)).sum(axis=1)
        return pa.table({"id": t["id"], "s": out})

    near = own.groupBy("cx", "cy").cogroup(sent.groupBy("cx", "cy")).applyInArrow(field, f"id {points.schema['id'].dataType.simpleString()}, s double")
    sums = near.unionByName(w.where(~F.coalesce(placed, F.lit(False))).select("id", F.col("w").alias("s")))
    return sums.select("id", (F.col("s") / (2 * np.pi * bandwidth * bandwidth * total.scalar())).alias("density"))
