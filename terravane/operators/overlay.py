"""Joins of geometries by how they relate, areas of two tables put together, buffers and repair.

Candidates for a join come from a grid of levels: a geometry stands in the at most four cells of the level whose cells are as wide as
its box, and in the cells above them on the levels the other table uses. Two geometries that meet share a cell of the coarser of their levels, so an equi-join on
(level, cell) finds them, and every pair is tested exactly afterwards. Cells that many geometries stand in are spread.

Geometries are text, GeoJSON or WKT, in plane coordinates. Defined cases: NULL, empty and unreadable geometries and rows
without an id meet nothing (with how="left" they come without a partner); ids are unique in each table; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.common import skew_join
from terravane.functions import planar
from terravane.session import cut

FINEST, COARSEST = -24, 40  # widths of cells as powers of two
MAX_SENT, MAX_TEXT = 200_000, 30_000_000  # rows and characters of a right side that goes to every task
SLICE = 1_000_000  # candidates at once
FINER, MAX_CELLS = 8, 1_000_000  # small cells in a cell, in one direction; small cells of all
FEW_SENT = 5_000  # right rows that are read where they are
_PLAIN = r"(?i)^\s*POLYGON\s*\(\(" + r"\s*,".join(rf"\s*(?P<x{k}>-?\d{{1,15}}(?:\.\d{{1,17}})?)\s+(?P<y{k}>-?\d{{1,15}}(?:\.\d{{1,17}})?)" for k in range(5)) + r"\s*\)\s*\)\s*$"


def _cells(df: DataFrame, above: list[int]) -> DataFrame:
    """(id, x0, y0, x1, y1, level, cx, cy, own): the cells a geometry stands in; own ones, and those above them on the levels of ``above``."""
    boxes = "id long, x0 double, y0 double, x1 double, y1 double, level int, cx long, cy long, own boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b["id"].to_pylist(), b["geometry"].to_pylist()):
                box = planar.read(text).box()
                if box is None or i is None:
                    continue
                width = max(box[2] - box[0], box[3] - box[1], 2.0**FINEST)
                level = int(np.clip(np.ceil(np.log2(width)), FINEST, COARSEST))
                for at in [level, *(x for x in above if x > level)]:
                    step = 2.0**at
                    (i0, j0), (i1, j1) = (np.floor(np.array(box[k : k + 2]) / step).astype(int).tolist() for k in (0, 2))
                    rows += [(i, *box, at, x, y, at == level) for x in range(i0, i1 + 1) for y in range(j0, j1 + 1)]
            cols = list(zip(*rows)) or [[]] * 9
            kinds = [pa.int64(), *[pa.float64()] * 4, pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in boxes.split(", ")])

    return df.select(F.col("id").cast("long").alias("id"), "geometry").mapInArrow(run, boxes)


def _flat(shape: planar.Shape) -> bool:
    """Whether the shape is exactly its box: one upright rectangle, level or upright line, or point."""
    if len(shape.points) + len(shape.lines) + len(shape.polygons) != 1:
        return False
    if len(shape.points):
        return True
    x0, y0, x1, y1 = shape.box()
    if shape.lines:
        return len(shape.lines[0]) == 2 and (x0 == x1) != (y0 == y1)
    rings = shape.polygons[0]
    if len(rings) != 1 or len(rings[0]) != 4 or x0 == x1 or y0 == y1:
        return False
    p = rings[0].tolist()
    turns = sum((p[k][0] == p[k - 1][0]) != (p[k][1] == p[k - 1][1]) for k in range(4))
    return turns == 4 and [x0, y0] in p and [x1, y1] in p


def _rectangles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, box) of the texts that plainly are one upright rectangle, read without shapes; others are left out."""
    found = pc.extract_regex(texts, _PLAIN)
    rows = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
    x, y = (np.stack([pc.struct_field(found, f"{c}{k}").take(pa.array(rows)).cast(pa.float64()).to_numpy() for k in range(5)], axis=1) for c in "xy")
    turns = (x[:, 1:] == x[:, :-1]) != (y[:, 1:] == y[:, :-1])
    box = np.stack([x.min(axis=1), y.min(axis=1), x.max(axis=1), y.max(axis=1)], axis=1)
    plain = turns.all(axis=1) & (x[:, 0] == x[:, 4]) & (y[:, 0] == y[:, 4]) & (x[:, 0] != x[:, 2]) & (y[:, 0] != y[:, 2])
    return rows[plain], box[plain]


class _Boxes:
    """Shapes by their boxes: (rows, 4), and whether each is its box."""

    def __init__(self, texts: list[str | None]) -> None:
        self.box = np.full((len(texts), 4), np.nan)
        self.flat, self.area = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        plain, box = _rectangles(pa.array(texts, pa.string()))
        self.box[plain], self.flat[plain], self.area[plain] = box, True, True
        for k in np.setdiff1d(np.arange(len(texts)), plain).tolist():
            shape = planar.read(texts[k])
            if (b := shape.box()) is not None:
                self.box[k], self.flat[k], self.area[k] = b, _flat(shape), bool(shape.polygons)


def _spread(left: DataFrame) -> DataFrame:
    """(id, geometry) in parts enough for all cores: a small file is read by few tasks, but its pairs are many."""
    return left.select(F.col("id").cast("long").alias("id"), "geometry").repartition(8 * left.sparkSession.sparkContext.defaultParallelism)


class _Sent:
    """The right side in a grid over its boxes, about as wide as they are."""

    def __init__(self, ids: np.ndarray, texts: list[str], box: np.ndarray, flat: np.ndarray) -> None:
        self.ids, self.texts, self.box, self.flat = ids, texts, box, flat
        if not len(ids):
            return
        self.low, self.high = box[:, :2].min(axis=0), box[:, 2:].max(axis=0)
        high = self.high
        width = np.maximum((box[:, 2:] - box[:, :2]).mean(axis=0), (high - self.low) / max(1.0, np.sqrt(len(ids))))
        self.step = np.where(width > 0, width, 1.0)
        self.side = np.floor((high - self.low) / self.step).astype(int) + 1
        cell, row = self._cells(box)
        order = np.argsort(cell, kind="stable")
        self.cell, self.row = cell[order], row[order]

    def _cells(self, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, row) of all cells a box stands in."""
        a, b = (np.clip(np.floor((box[:, k : k + 2] - self.low) / self.step), 0, self.side - 1).astype(int) for k in (0, 2))
        n = (b - a + 1).prod(axis=1)
        row = np.repeat(np.arange(len(box)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        tall = (b - a + 1)[row, 1]
        return (a[row, 0] + k // tall) * self.side[1] + a[row, 1] + k % tall, row

    def outer(self, area: np.ndarray) -> _Sent:
        """Without the rectangles, told by ``area``, that lie in another one and share a corner with it: together they cover the same."""
        keep = np.ones(len(self.ids), bool)
        for k in (0, 2):
            for m in (1, 3):
                at = np.flatnonzero(area & keep)
                x, y = self.box[at, k], self.box[at, m]
                far_x, far_y = (self.box[at, 2 - k] * (1 - k), self.box[at, 4 - m] * (2 - m))
                _, far_y = np.unique(far_y, return_inverse=True)
                order = np.lexsort((-far_y, -far_x, y, x))
                corner = np.append(0, np.cumsum((x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])))[: len(at)]
                reach = corner * (len(at) + 1) + far_y[order]
                inner = (corner[1:] == corner[:-1]) & (np.maximum.accumulate(reach)[:-1] >= reach[1:])
                keep[at[order[1:][inner]]] = False
        rows = np.flatnonzero(keep)
        return _Sent(self.ids[rows], [self.texts[r] for r in rows], self.box[rows], self.flat[rows])

    def fill(self, area: np.ndarray) -> None:
        """Counts the small cells that do not lie whole, and a little beyond, in one of the rectangles told by ``area``: ``open`` has those below and left of each corner."""
        if not len(self.ids):
            return
        parts = max(1, min(FINER, int(np.sqrt(MAX_CELLS / self.side.prod()))))
        self.fine, size = self.step / parts, self.side * parts
        self.edge = 1e-9 + 4 * np.finfo(float).eps * np.maximum(np.abs(self.low), np.abs(self.high)) / self.fine  # cells are found by rounding
        low, high = self.box[area, :2], self.box[area, 2:]
        a = np.where(low <= self.low, 0, np.ceil((low - self.low) / self.fine + 2 * self.edge)).astype(int)
        b = np.where(high >= self.high, size, np.floor((high - self.low) / self.fine - 2 * self.edge)).astype(int)
        some = (a < b).all(axis=1)
        (i0, j0), (i1, j1) = a[some].T, b[some].T
        whole = np.zeros(size + 1, np.int32)
        for i, j, n in ((i0, j0, 1), (i1, j1, 1), (i0, j1, -1), (i1, j0, -1)):
            np.add.at(whole, (i, j), n)
        lacking = whole.cumsum(axis=0).cumsum(axis=1)[:-1, :-1] == 0
        self.open = np.pad(lacking.astype(np.int32).cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32), ((1, 0), (1, 0)))

    def covers(self, box: np.ndarray) -> np.ndarray:
        """Whether all small cells a box stands in lie whole in right rectangles, so that nothing of it is left."""
        out = np.zeros(len(box), bool)
        if len(self.ids):
            at = np.flatnonzero((box[:, :2] >= self.low).all(axis=1) & (box[:, 2:] <= self.high).all(axis=1))
            most = np.array(self.open.shape) - 1
            i0, j0 = np.clip(np.floor((box[at, :2] - self.low) / self.fine + self.edge), 0, most - 1).astype(int).T
            i1, j1 = np.clip(np.ceil((box[at, 2:] - self.low) / self.fine - self.edge), 1, most).astype(int).T
            i1, j1 = np.maximum(i1, i0 + 1), np.maximum(j1, j0 + 1)
            out[at] = self.open[i1, j1] - self.open[i0, j1] - self.open[i1, j0] + self.open[i0, j0] == 0
        return out

    def meeting(self, box: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(left row, right row) of all boxes that meet, once each and slice by slice; all pairs of a left row come in one slice."""
        at = np.flatnonzero(~np.isnan(box[:, 0])) if len(self.ids) else np.empty(0, int)
        if not len(at):
            return
        cell, row = self._cells(box[at])
        row = at[row]
        first, last = (np.searchsorted(self.cell, cell, side=s) for s in ("left", "right"))
        n = last - first
        total = np.cumsum(n)
        ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1  # behind the last cell of each left row
        start = 0
        while start < len(row):
            done = total[start] - n[start]
            stop = int(ends[max(np.searchsorted(ends, start, side="right"), np.searchsorted(total[ends - 1], done + SLICE, side="right") - 1)])
            m = n[start:stop]
            i, c = np.repeat(row[start:stop], m), np.repeat(cell[start:stop], m)
            j = self.row[np.repeat(first[start:stop], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            a, b = box[i], self.box[j]
            corner = np.clip(np.floor((np.maximum(a[:, :2], b[:, :2]) - self.low) / self.step), 0, self.side - 1).astype(int)
            keep = (a[:, :2] <= b[:, 2:]).all(axis=1) & (b[:, :2] <= a[:, 2:]).all(axis=1) & (corner[:, 0] * self.side[1] + corner[:, 1] == c)
            yield i[keep], j[keep]
            start = stop


def _sent(right: DataFrame) -> _Sent | None:
    """The right side for every task, its boxes found by the cluster; None if it is too large for that."""
    told = "id long, geometry string, x0 double, y0 double, x1 double, y1 double, flat boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = _Boxes(b["geometry"].to_pylist())
            cols = [b["id"], b["geometry"], *[pa.array(made.box[:, k]) for k in range(4)], pa.array(made.flat)]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in told.split(", ")]).filter(pa.array(~np.isnan(made.box[:, 0])))

    rows = right.select(F.col("id").cast("long").alias("id"), "geometry").where("id is not null and geometry is not null")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("geometry")).alias("c")).first()
    if size["n"] > MAX_SENT or (size["c"] or 0) > MAX_TEXT:
        return None
    t = (rows if size["n"] <= FEW_SENT else _spread(rows)).mapInArrow(run, told).toArrow()
    box = np.stack([t[c].to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1)
    return _Sent(t["id"].to_numpy(), t["geometry"].to_pylist(), box, t["flat"].to_numpy())


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether box shapes a lie in box shapes b, and not only on their rims."""
    tol = 1e-12 * np.maximum(1.0, np.maximum(np.abs(a).max(axis=1), np.abs(b).max(axis=1)))[:, None]
    covered = (a[:, :2] >= b[:, :2] - tol).all(axis=1) & (a[:, 2:] <= b[:, 2:] + tol).all(axis=1)
    low, high = np.maximum(a[:, :2], b[:, :2]), np.minimum(a[:, 2:], b[:, 2:])
    point = a[:, :2] == a[:, 2:]  # in this direction
    inner = np.where(point, (a[:, :2] > b[:, :2] + tol) & (a[:, :2] < b[:, 2:] - tol), low < high)
    return covered & inner.all(axis=1)


def _within_sent(left: DataFrame, right: _Sent, how: str) -> DataFrame:
    """(left_id, right_id): in which right shapes each left shape lies; no pair moves."""
    area = right.flat & (right.box[:, 0] < right.box[:, 2]) & (right.box[:, 1] < right.box[:, 3]) if len(right.ids) else right.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = b["geometry"].to_pylist(), b["id"]
            boxes = _Boxes([None if k is None else x for k, x in zip(ids.to_pylist(), texts)])
            alone = np.ones(len(texts), bool)
            for i, j in right.meeting(boxes.box):
                held = np.zeros(len(i), bool)
                plain = boxes.flat[i] & area[j]
                held[plain] = _within(boxes.box[i[plain]], right.box[j[plain]])
                for k in np.flatnonzero(~plain):
                    held[k] = planar.relate(planar.read(texts[i[k]]), planar.read(right.texts[j[k]]))["within"]
                i, j = i[held], j[held]
                alone[i] = False
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(right.ids[j], pa.int64())], ["left_id", "right_id"])
            if how == "left":
                rest = ids.filter(pa.array(alone))
                yield pa.RecordBatch.from_arrays([rest, pa.nulls(len(rest), pa.int64())], ["left_id", "right_id"])

    return _spread(left).mapInArrow(run, "left_id long, right_id long")


def _rest_of_box(box: np.ndarray, others: np.ndarray) -> list[np.ndarray]:
    """Rectangles that the boxes leave of a box: free runs between their sides, row by row, equal runs above each other put together."""
    x, y = (np.unique(np.clip(np.concatenate([others[:, k], others[:, k + 2], box[[k, k + 2]]]), box[k], box[k + 2])) for k in (0, 1))
    taken = np.zeros((len(y), len(x)), int)
    (i0, i1), (j0, j1) = ((np.searchsorted(c, np.clip(others[:, k], *box[[k, k + 2]])), np.searchsorted(c, np.clip(others[:, k + 2], *box[[k, k + 2]]))) for k, c in ((0, x), (1, y)))
    for j, i, n in ((j0, i0, 1), (j1, i1, 1), (j0, i1, -1), (j1, i0, -1)):
        np.add.at(taken, (j, i), n)
    free = taken.cumsum(axis=0).cumsum(axis=1)[:-1, :-1] == 0
    made, going = [], {}
    for k, row in enumerate([*free, np.zeros(len(x) - 1, bool)]):
        turn = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(int), [0]])))
        runs = set(zip(turn[::2].tolist(), turn[1::2].tolist()))
        for run in [g for g in going if g not in runs]:
            low = going.pop(run)
            made.append(np.array([(x[run[0]], y[low]), (x[run[1]], y[low]), (x[run[1]], y[k]), (x[run[0]], y[k])]))
        for run in runs:
            going.setdefault(run, k)
    return made


def _left_over_sent(left: DataFrame, right: _Sent) -> DataFrame:
    """``_left_over`` with the right side in every task: no pair moves, and rectangles are cut by rectangles on their sides. What stands in covered cells meets nothing."""
    areas = lambda r: r.flat & (r.box[:, 0] < r.box[:, 2]) & (r.box[:, 1] < r.box[:, 3]) if len(r.ids) else r.flat
    right = right.outer(areas(right))
    area = areas(right)
    right.fill(area)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["geometry"].to_pylist()
            boxes = _Boxes(texts)
            made: dict[int, list[np.ndarray]] = {}
            met = right.covers(boxes.box)
            for i, j in right.meeting(np.where(met[:, None], np.nan, boxes.box)):
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.empty(0, int)
                for lo, hi in zip(cuts, np.append(cuts[1:], len(i))):
                    k, others = int(i[lo]), j[lo:hi]
                    met[k] = True
                    if boxes.flat[k] and boxes.area[k] and area[others].all():
                        c, d = boxes.box[k], right.box[others]
                        made[k] = [] if ((d[:, :2] <= c[:2]) & (d[:, 2:] >= c[2:])).all(axis=1).any() else _rest_of_box(c, d)
                    else:
                        made[k] = planar.combine(planar.read(texts[k]).polygons, [p for o in others for p in planar.read(right.texts[o]).polygons], planar.OVERLAYS["difference"])
            for k in np.flatnonzero(~met & boxes.flat & boxes.area):
                x0, y0, x1, y1 = boxes.box[k]
                made[int(k)] = [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]
            for k in np.flatnonzero(~met & ~(boxes.flat & boxes.area)):
                made[int(k)] = planar.combine(planar.read(texts[k]).polygons, [], planar.OVERLAYS["difference"])
            rows = [(k, planar.to_geojson(m), planar.total_area(m)) for k, m in made.items() if m]
            rows = [x for x in rows if x[2] > 0]
            cols = [b["id"].take(pa.array([x[0] for x in rows], pa.int64())), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["left_id", "geometry", "area"])

    return _spread(left.where("id is not null")).mapInArrow(run, "left_id long, geometry string, area double")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of all geometries whose boxes meet."""
    named = lambda df, p: df.select(*[F.col(c).alias(c if c in ("level", "cx", "cy") else f"{p}_{c}") for c in df.columns])
    used = [sorted(r["level"] for r in _cells(df, []).select("level").distinct().collect()) for df in (left, right)]  # at most COARSEST - FINEST + 1
    a, b = named(_cells(left, used[1]), "l"), named(_cells(right, used[0]), "r")
    keys = ["level", "cx", "cy"]
    meet = (F.col("l_x0") <= F.col("r_x1")) & (F.col("l_x1") >= F.col("r_x0")) & (F.col("l_y0") <= F.col("r_y1")) & (F.col("l_y1") >= F.col("r_y0"))
    down = skew_join(a, b.where("r_own"), keys, "inner", F.col("l_id"))
    up = skew_join(b.where("not r_own"), a.where("l_own"), keys, "inner", F.col("r_id"))
    pick = lambda df: df.where(meet).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))
    return pick(down).unionByName(pick(up)).distinct()


def _texts(left: DataFrame, right: DataFrame) -> DataFrame:
    pairs = cut(candidates(left, right))  # read several times below
    with_left = skew_join(pairs, left.select(F.col("id").cast("long").alias("left_id"), F.col("geometry").alias("a")), ["left_id"], "inner", F.col("right_id"))
    return skew_join(with_left, right.select(F.col("id").cast("long").alias("right_id"), F.col("geometry").alias("b")), ["right_id"], "inner", F.col("left_id"))


def relations(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, one flag per relation) of all pairs that meet. Tables: (id, geometry)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            told = [planar.relate(planar.read(a), planar.read(b)) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist())]
            keep = pa.array([x["intersects"] for x in told], pa.bool_())
            flags = [pa.array([x[r] for x in told], pa.bool_()) for r in planar.RELATIONS]
            yield pa.RecordBatch.from_arrays([t["left_id"], t["right_id"], *flags], ["left_id", "right_id", *planar.RELATIONS]).filter(keep)

    return _texts(left, right).mapInArrow(run, "left_id long, right_id long, " + ", ".join(f"{r} boolean" for r in planar.RELATIONS))


def spatial_join(left: DataFrame, right: DataFrame, predicate: str = "intersects", how: str = "inner") -> DataFrame:
    """(left_id, right_id) of all pairs for which ``predicate`` holds; with how="left" also left rows without a partner."""
    if predicate not in planar.RELATIONS or how not in ("inner", "left"):
        raise ValueError(f"predicate must be one of {planar.RELATIONS}, how inner or left")
    if predicate == "within" and (sent := _sent(right)) is not None:
        return _within_sent(left, sent, how)
    found = relations(left, right).where(predicate).select("left_id", "right_id")
    return found if how == "inner" else left.select(F.col("id").cast("long").alias("left_id")).join(found, "left_id", "left")


def intersections(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, geometry, area) of the common area of all pairs that share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            made = [planar.combine(planar.read(a).polygons, planar.read(b).polygons, planar.OVERLAYS["intersection"]) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist())]
            area = [planar.total_area(m) for m in made]
            cols = [t["left_id"], t["right_id"], pa.array(list(map(planar.to_geojson, made)), pa.string()), pa.array(area, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["left_id", "right_id", "geometry", "area"]).filter(pa.array([x > 0 for x in area], pa.bool_()))

    return _texts(left, right).mapInArrow(run, "left_id long, right_id long, geometry string, area double")


def _left_over(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, geometry, area) of what is left of each area without those of the other table. All areas that meet one come together."""
    if (sent := _sent(right)) is not None:
        return _left_over_sent(left, sent)
    met = _texts(left, right).select("left_id", "a", "b")
    alone = left.select(F.col("id").cast("long").alias("left_id"), F.col("geometry").alias("a"), F.lit(None).cast("string").alias("b"))

    def run(t: pa.Table) -> pa.Table:
        others = [p for text in t["b"].to_pylist() if text for p in planar.read(text).polygons]
        left_ = planar.combine(planar.read(t["a"][0].as_py()).polygons, others, planar.OVERLAYS["difference"])
        area = planar.total_area(left_)
        rows = [0] if area > 0 else []
        return pa.table({"left_id": t["left_id"].take(pa.array(rows, pa.int64())), "geometry": pa.array([planar.to_geojson(left_)] * len(rows), pa.string()), "area": pa.array([area] * len(rows), pa.float64())})

    return met.unionByName(alone.where("left_id is not null")).groupBy("left_id").applyInArrow(run, "left_id long, geometry string, area double")


def overlay(left: DataFrame, right: DataFrame, how: str = "intersection") -> DataFrame:
    """(left_id, right_id, geometry, area) of the areas of two tables put together.

    how: intersection (common areas), difference (of the left ones), union (common areas, and what is left of either side with
    the other id NULL).
    """
    none = F.lit(None).cast("long")
    of_left = lambda: _left_over(left, right).select("left_id", none.alias("right_id"), "geometry", "area")
    if how == "intersection":
        return intersections(left, right)
    if how == "difference":
        return of_left()
    if how == "union":
        of_right = _left_over(right, left).select(none.alias("left_id"), F.col("left_id").alias("right_id"), "geometry", "area")
        return intersections(left, right).unionByName(of_left()).unionByName(of_right)
    raise ValueError("how must be intersection, difference or union")


def _each(df: DataFrame, work, schema: str) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        fields = [f.split() for f in schema.split(", ")]
        for b in batches:
            made = [work(planar.read(t)) for t in b["geometry"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], *[pa.array([m[k] for m in made], kinds[kind]) for k, (_, kind) in enumerate(fields)]], ["id", *[n for n, _ in fields]])

    return df.select("id", "geometry").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, {schema}")


def buffers(df: DataFrame, radius: float, metric: bool = False, corners: int = 32) -> DataFrame:
    """(id, geometry, area) of everything at most ``radius`` away from points, lines (corridors) and areas.

    metric: coordinates are lon/lat and the radius is in metres, measured on the plane that touches the earth's sphere at the
    middle latitude of each geometry; the area is in square metres.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")

    def work(shape: planar.Shape) -> tuple[str | None, float | None]:
        box = shape.box()
        if box is None:
            return None, None
        scale = np.ones(2)
        if metric:
            scale = np.radians(1) * 6_371_008.8 * np.array([max(np.cos(np.radians((box[1] + box[3]) / 2)), 1e-6), 1.0])
        moved = planar.Shape(shape.points * scale, [x * scale for x in shape.lines], [[r * scale for r in p] for p in shape.polygons])
        pieces = planar.buffered(moved, radius, corners)
        return planar.to_geojson([r / scale for r in pieces]), planar.total_area(pieces)

    return _each(df, work, "geometry string, area double")


def repaired(df: DataFrame) -> DataFrame:
    """(id, geometry, area, was_valid): areas with edges that cross are read by the even-odd rule and cut into sound pieces; others stay as they are."""

    def work(shape: planar.Shape) -> tuple[str | None, float, bool]:
        sound = not planar.crossing_itself(shape)
        pieces = [p for polygon in shape.polygons for p in planar.combine([polygon], [], planar.OVERLAYS["union"])]
        return None if sound else planar.to_geojson(pieces), planar.total_area(planar.combine(shape.polygons, [], planar.OVERLAYS["union"])), sound

    made = _each(df, work, "mended string, area double, was_valid boolean")
    return df.select("id", "geometry").join(made, "id").select("id", F.coalesce("mended", "geometry").alias("geometry"), "area", "was_valid")
