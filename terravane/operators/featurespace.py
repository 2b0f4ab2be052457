"""Exact nearest rows in feature space, for tables of any size.

Equal rows are held once with their number. The distinct vectors are split into cells by a k-d tree over a sample; the tree
steers the load, never the result. Two steps follow. In its own cell each vector finds k rows, which bounds the radius it
has to look within; far from the others the sample bounds it better. The vectors of a cell with radii of one magnitude then form a group
with a tight box, every vector that lies within the group's radius of the box (of a member, in a small group) is sent there,
and each member takes its k nearest from all of them. Ties of
distance go to the smaller vector, so the choice depends on neither ids nor cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.stats import finite
from terravane.session import cut

CELL_ROWS, MAX_CELLS, PER_CELL, LEAF = 512, 16_384, 4, 24
SINGLE = 32  # groups of at most so many members are met by their members' own balls instead of one box
SLACK = 1 + 1e-9  # pruning keeps this much more than the radius; the exact choice follows


class Cells:
    """A k-d tree over a sample; its leaves are the cells, numbered in order."""

    def __init__(self, sample: np.ndarray, rows: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, left, right; axis -1: left is the cell
        self.count = 0
        self._split(sample, rows)

    def _split(self, x: np.ndarray, rows: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0))
        if len(x) > rows:
            for axis in np.argsort(x.min(axis=0) - x.max(axis=0), kind="stable"):
                at = np.partition(x[:, axis], len(x) // 2)[len(x) // 2]
                low = x[:, axis] < at
                if not low.any():
                    at = np.nextafter(at, np.inf)
                    low = x[:, axis] < at
                if low.any() and not low.all():
                    self.nodes[me] = (int(axis), float(at), self._split(x[low], rows), self._split(x[~low], rows))
                    return me
        self.nodes[me] = (-1, 0.0, self.count, 0)
        self.count += 1
        return me

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            axis, at, left, right = self.nodes[node]
            if axis < 0:
                out[rows] = left
            elif len(rows):
                low = x[rows, axis] < at
                stack += [(left, rows[low]), (right, rows[~low])]
        return out


def nearest(x: np.ndarray, w: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (queries, chosen vectors, rows taken of each, squared distances), nearest first; x is in the order that decides ties.

    A query is a position in x, and one of the rows of its vector is the query itself. Fewer than k rows are taken where there are no more.
    """
    top = min(k + 1, len(x))
    block = max(1, 2_000_000 // len(x))
    for s in range(0, len(queries), block):
        q = queries[s : s + block]
        d = np.zeros((len(q), len(x)))
        for c in range(x.shape[1]):
            d += np.subtract.outer(x[q, c], x[:, c]) ** 2
        near = np.argpartition(d, top - 1, axis=1)[:, :top]
        edge = np.take_along_axis(d, near, axis=1).max(axis=1)
        tied = np.flatnonzero((d <= edge[:, None]).sum(axis=1) > top)
        if len(tied):
            near[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :top]
        near = np.sort(near, axis=1)
        d = np.take_along_axis(d, near, axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
        have = w[near] - (near == q[:, None])
        yield q, near, np.clip(k - (np.cumsum(have, axis=1) - have), 0, have), d


def _ordered(t: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.stack([t[c].to_numpy() for c in columns], axis=1)
    order = np.lexsort(x.T[::-1])
    return x[order], t["w"].to_numpy()[order], order


def _boxed(x: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) of all rows at most ``reach`` from a box."""
    d = np.zeros((len(x), len(low)))
    for c in range(x.shape[1]):
        d += np.maximum(0.0, np.maximum(low[None, :, c] - x[:, c, None], x[:, c, None] - high[None, :, c])) ** 2
    return np.nonzero(d <= (reach * SLACK)[None, :] ** 2)


def _typical(sample: np.ndarray, k: int) -> float:
    """Median squared distance to the k-th nearest in the sample, over some of its rows."""
    if len(sample) <= k:
        return 0.0
    some = sample[:: max(1, len(sample) // 64)]
    return float(np.median([np.partition(((sample - v) ** 2).sum(axis=1), k)[k] for v in some]))


def per_neighbourhood(df: DataFrame, columns: list[str], k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], out: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, out): ``score`` of each row's k nearest other rows; NULL for a row without all its features.

    ``score`` takes the vectors (rows, neighbours, columns) and how many rows each stands for (rows, neighbours).
    """
    names = [f"f{i}" for i in range(len(columns))]

    def judged(x: np.ndarray, near: np.ndarray, used: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        return {**{c: x[:, i] for i, c in enumerate(names)}, out: score(near, used)}

    kept, scores = _search(df, columns, k, judged, f"{out} double", cell_rows)
    return kept.select("id", F.lit(None).cast("double").alias(out)) if scores is None else kept.join(scores, names, "left").select("id", out)


def neighbour_list(df: DataFrame, columns: list[str], k: int, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The rows (id, f0, f1, ..) and the edges (f0, .., g0, .., n, d) of distinct vectors f: n rows of the vector g at distance d are among the k nearest other rows."""
    names, others = [f"f{i}" for i in range(len(columns))], [f"g{i}" for i in range(len(columns))]

    def listed(x: np.ndarray, near: np.ndarray, used: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        i, j = np.nonzero(used > 0)
        return {**{c: x[i, m] for m, c in enumerate(names)}, **{c: near[i, j, m] for m, c in enumerate(others)}, "n": used[i, j].astype(np.int64), "d": np.sqrt(d[i, j])}

    return _search(df, columns, k, listed, ", ".join([*[f"{c} double" for c in others], "n long", "d double"]), cell_rows)


def _search(df: DataFrame, columns: list[str], k: int, make: Callable[..., dict[str, np.ndarray]], made_schema: str, cell_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """What ``make`` gives for the neighbourhoods of blocks of distinct vectors; None where no row has all its features.

    The driver holds the sample and the groups' boxes, both bounded by the number of cells.
    """
    spark, names = df.sparkSession, [f"f{i}" for i in range(len(columns))]
    kept = df.select("id", *[(finite(F.col(c).cast("double")) + F.lit(0.0)).alias(n) for c, n in zip(columns, names)])
    whole = kept.dropna(subset=names)
    distinct = cut(whole.groupBy(*names).agg(F.count("*").alias("w")))
    n = distinct.count()
    if not n:
        return kept, None
    every = max(1, cell_rows // PER_CELL, n // (MAX_CELLS * PER_CELL))
    seeds = distinct.select(*names)
    if n > 64 * k:  # enough for k rows whatever the hash picks
        seeds = seeds.where(F.pmod(F.xxhash64(*names), F.lit(min(every, n // (16 * k)))) == 0)
    sample = seeds.toPandas()[names].to_numpy(float)
    sample = sample[np.lexsort(sample.T[::-1])]
    cells = Cells(sample, max(1, round(len(sample) * max(cell_rows, n / MAX_CELLS) / n)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    usual = _typical(sample, k)
    fields = ", ".join(f"{c} double" for c in names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b[c].to_numpy() for c in names], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.of(x))], [*names, "w", "cell"])

    def bound(t: pa.Table) -> pa.Table:
        x, w, order = _ordered(t, names)
        r = np.full(len(x), np.inf)
        for q, _, used, d in nearest(x, w, np.arange(len(x)), k):
            r[q] = np.where(used.sum(axis=1) >= k, np.where(used > 0, d, 0).max(axis=1), np.inf)
        lone = np.flatnonzero(r > usual)
        for s in range(0, len(lone) if len(sample) > k else 0, 64):
            at = lone[s : s + 64]
            d = np.zeros((len(at), len(sample)))
            for c in range(x.shape[1]):
                d += np.subtract.outer(x[at, c], sample[:, c]) ** 2
            r[at] = np.minimum(r[at], np.partition(d, k, axis=1)[:, k])  # one of the k + 1 may be the vector itself
        return t.take(pa.array(order)).append_column("r", pa.array(np.sqrt(r)))

    placed = distinct.mapInArrow(place, f"{fields}, w long, cell int")
    sized = F.when(F.col("r") == float("inf"), 9_999).when(F.col("r") > 0, F.floor(F.log2("r"))).otherwise(-9_999).cast("int").alias("size")
    bounded = cut(placed.repartition(tasks, "cell").groupBy("cell").applyInArrow(bound, f"{fields}, w long, cell int, r double").select("*", sized))
    members = F.collect_list(F.array(*names, "r"))
    groups = bounded.groupBy("size", "cell").agg(*[e for c in names for e in (F.min(c).alias(f"{c}a"), F.max(c).alias(f"{c}b"))], F.max("r").alias("r"), F.when(F.count("*") <= SINGLE, members).alias("m")).toPandas().sort_values(["size", "cell"], ignore_index=True)
    key = {(int(s), int(c)): g for g, (s, c) in enumerate(zip(groups["size"], groups["cell"]))}
    box = []
    for g, (a, b, r, m) in enumerate(zip(groups[[f"{c}a" for c in names]].to_numpy(float), groups[[f"{c}b" for c in names]].to_numpy(float), groups["r"], groups["m"])):
        box += [(g, a, b, r)] if m is None else [(g, np.array(v[:-1], float), np.array(v[:-1], float), v[-1]) for v in m]
    owner, reach = np.array([v[0] for v in box]), np.array([v[3] for v in box], float)
    low, high = np.stack([v[1] for v in box]), np.stack([v[2] for v in box])
    starts = np.arange(0, len(owner), max(1, int(np.sqrt(len(owner)))))  # boxes of one magnitude and near cells are tried together
    wide = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(reach, starts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b[c].to_numpy() for c in names], axis=1)
            own = np.array([key[at] for at in zip(b["size"].to_pylist(), b["cell"].to_pylist())])
            row1, block = _boxed(x, *wide)
            hit = []
            for i in np.unique(block):
                rows, a = row1[block == i], starts[i]
                e = starts[i + 1] if i + 1 < len(starts) else len(owner)
                row, g = _boxed(x[rows], low[a:e], high[a:e], reach[a:e])
                hit.append(np.stack([rows[row], owner[g + a]], axis=1))
            row, g = np.unique(np.concatenate(hit), axis=0).T
            for at in range(0, len(row), 200_000):
                row_, g_ = row[at : at + 200_000], g[at : at + 200_000]
                take = pa.array(row_)
                yield pa.RecordBatch.from_arrays([pa.array(g_, pa.int32()), *[b[c].take(take) for c in (*names, "w", "r")], pa.array(own[row_] == g_)], ["grp", *names, "w", "r", "home"])

    def judge(t: pa.Table) -> pa.Table:
        x, w, order = _ordered(t, names)
        home, r = np.flatnonzero(t["home"].to_numpy()[order]), t["r"].to_numpy()[order]
        made: list[pa.Table] = []
        part = Cells(x[home], LEAF).of(x[home])
        for i in range(part.max() + 1):  # a few queries at a time, on the rows that lie within their radius of their box
            own = home[part == i]
            if not len(own):
                continue
            at, _ = _boxed(x, x[own].min(axis=0)[None], x[own].max(axis=0)[None], r[own].max(keepdims=True))
            for q, near, used, d in nearest(x[at], w[at], np.searchsorted(at, own), k):
                made.append(pa.table(make(x[at[q]], x[at[near]], used, d)))
        return pa.concat_tables(made)

    sent = bounded.mapInArrow(send, f"grp int, {fields}, w long, r double, home boolean")
    return kept, sent.repartition(tasks, "grp").groupBy("grp").applyInArrow(judge, f"{fields}, {made_schema}")
