"""Rows in compressed blobs, a part of the table each, and what is counted on them in place: places in order, neighbours at one position, outlier factors.

A blob is an Arrow table of columns that are alike in neighbouring rows, so it takes a fraction of the rows; what is made of
it is counted where it is made, so no measure of every row is written or sorted.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.stats import finite
from terravane.operators import factor, neighbours
from terravane.operators.featurespace import Cells
from terravane.session import cut, swept

HELD_ROWS = 4_000_000  # a task holds so many rows at most
TILE_ROWS, PER_TILE = 800_000, 256
GATHERED = 1_500_000
EDGES = 4_000
MOST_CANDIDATES, MOST_UNSURE, GROUP = 4_000_000, 400_000, 256
BLOB = "part int, kind int, n long, told array<double>, data binary"
OWN, OTHER, SURE, UNSURE, LOOSE = range(5)  # LOOSE: rows of a part that is too large for a task


def _blob(columns: dict[str, np.ndarray]) -> bytes:
    t, sink = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> dict[str, np.ndarray]:
    t = pa.ipc.open_stream(data).read_all()
    return {c: t[c].to_numpy() for c in t.column_names}


def _joined(many: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([m[c] for m in many]) for c in many[0]}


def _row(part: int, kind: int, n: int, told: list[float], data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([n], pa.int64()), pa.array([told], pa.list_(pa.float64())), pa.array([data], pa.binary())], ["part", "kind", "n", "told", "data"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for at in range(b.num_rows):
            yield {c: b[c][at].as_py() for c in b.schema.names}


def _by_part(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    held = defaultdict(list)
    for r in _each(batches):
        held[r["part"]].append(r)
    return held


def pack(df: DataFrame, values: list[str], flags: list[str]) -> DataFrame:
    """Blobs of (id, x, y, v0, v1, ..), all rows of a position in one, ordered by position and id; NaN where a value or the position is missing.

    df: (id long, x, y, values, flags). told: rows with a position, then for each value its rows, those with a position, and those with each flag.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = [f"v{i}" for i in range(len(values))]
    x, y = (finite(F.col(c).cast("double")) + F.lit(0.0) for c in "xy")
    placed = x.isNotNull() & y.isNotNull()
    lost = F.lit(float("nan"))
    rows = df.select(F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("id"), F.when(placed, x).otherwise(lost).alias("x"), F.when(placed, y).otherwise(lost).alias("y"), *[F.coalesce(finite(F.col(c).cast("double")) + F.lit(0.0), lost).alias(n) for c, n in zip(values, names)], *[F.coalesce(F.col(c), F.lit(False)).alias(f"__{c}") for c in flags])
    rows = rows.withColumn("part", F.pmod(F.when(~F.isnan("x"), F.xxhash64("x", "y")).otherwise(F.xxhash64("id", *names)), F.lit(tasks)).cast("int"))

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {n: t[n].to_numpy() for n in ("id", "x", "y", *names)}
        part, marks = t["part"].to_numpy(), [t[f"__{f}"].to_numpy() for f in flags]
        order = np.argsort(part, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(part[order]) != 0, True)) + 1
        for a, b in zip(np.append(0, ends[:-1]), ends):
            at = order[a:b]
            mine, there = {n: v[at] for n, v in c.items()}, ~np.isnan(c["x"][at])
            told = [int(there.sum())]
            for n in names:
                known = ~np.isnan(mine[n])
                told += [int(known.sum()), int((known & there).sum()), *[int((known & m[at]).sum()) for m in marks]]
            yield _row(int(part[at[0]]), OWN, len(at), told, _blob(mine))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, n = [], 0
        for b in batches:
            mine.append(b)
            n += b.num_rows
            if n >= GATHERED:
                yield from flush(pa.Table.from_batches(mine))
                mine, n = [], 0
        if n:
            yield from flush(pa.Table.from_batches(mine))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches).items():
            if sum(r["n"] for r in rows) > HELD_ROWS:
                for r in rows:
                    yield _row(part, LOOSE, r["n"], r["told"], r["data"])
                continue
            t = _joined([_read(r["data"]) for r in rows])
            order = np.lexsort((t["id"], t["y"], t["x"]))
            yield _row(part, OWN, len(order), np.sum([r["told"] for r in rows], axis=0).tolist(), _blob({c: v[order] for c, v in t.items()}))

    out = cut(rows.mapInArrow(packed, BLOB).repartitionById(tasks, F.col("part")).mapInArrow(merged, BLOB))
    swept(spark)
    return out


def told(blobs: DataFrame) -> tuple[list[int], bool]:
    """The sums of told, and whether every part is whole."""
    rows = blobs.select("kind", "told").collect()  # as many as parts
    return ([round(v) for v in np.sum([r["told"] for r in rows], axis=0)] if rows else []), all(r["kind"] != LOOSE for r in rows)


def moments(blobs: DataFrame, value: str) -> tuple[float, float]:
    """Mean and standard deviation of a value over the rows that also have a position."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            t = _read(r["data"])
            v = t[value][~np.isnan(t["x"]) & ~np.isnan(t[value])]
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in (len(v), v.mean(), v.var() * len(v))], ["n", "m", "q"])

    n, m, q = blobs.select("data").mapInArrow(share, "n double, m double, q double").toPandas().sort_values(["n", "m", "q"]).to_numpy().T
    mean = float((n * m).sum() / n.sum())
    return mean, math.sqrt(float((q + n * (m - mean) ** 2).sum()) / (n.sum() - 1))


def unpack(blobs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows again, {column: its new name}; NULL where a value is missing."""
    kinds = ["long" if c == "id" else "double" for c in columns]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            t = _read(r["data"])
            for s in range(0, r["n"], 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(t[c][s : s + 65_536], from_pandas=c != "id") for c in columns], list(columns.values()))

    return blobs.select("n", "data").mapInArrow(rows, ", ".join(f"{n} {k}" for n, k in zip(columns.values(), kinds)))


def value_shares(blobs: DataFrame, column: str) -> DataFrame:
    """(value, same): the values of a column, counted part by part; a value is there once for each part that has it."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            v = _read(r["data"])[column]
            v, n = np.unique(v[~np.isnan(v)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n)], ["value", "same"])

    return blobs.select("data").mapInArrow(shares, "value double, same long")


def places(v: np.ndarray, i: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How many of the ends, pairs (ends, ids) in order, are at most each pair (v, i)."""
    low, high = np.searchsorted(ends, v, side="left"), np.searchsorted(ends, v, side="right")
    tied = np.flatnonzero(low < high)
    if len(tied):
        group = low[tied]
        starts = np.unique(group)
        if len(starts) <= 64:
            for a in starts:
                at = tied[group == a]
                low[at] += np.searchsorted(ids[a : high[at[0]]], i[at], side="right")
        else:
            both = np.lexsort((np.append(np.zeros(len(ids), bool), np.ones(len(tied), bool)), np.append(ids, i[tied]), np.append(ends, v[tied])))
            mine = both >= len(ids)
            low[tied[both[mine] - len(ids)]] = np.cumsum(~mine)[mine]
    return low


def counted_places(measures: DataFrame, read: Callable[[dict], dict[str, np.ndarray]], ends: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """Rows by their number of ends at most as large, for each measure; ``read`` makes (id, measures) of a blob."""
    sent = measures.sparkSession.sparkContext.broadcast(ends)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for r in _each(batches):
            t = read(r)
            for name, (v, i) in sent.value.items():
                total[name] = total.get(name, 0) + np.bincount(places(t[name], t["id"], v, i), minlength=len(v) + 1)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], ["m", "at", "n"])

    found = measures.mapInArrow(count, "m string, at long, n long").groupBy("m", "at").agg(F.sum("n").alias("n")).toArrow()
    out = {name: np.zeros(len(v) + 1, np.int64) for name, (v, _) in ends.items()}
    which, at, n = (found[c].to_numpy() for c in ("m", "at", "n"))
    for name in out:
        mine = which == name
        out[name][at[mine]] = n[mine]
    sent.unpersist()
    return out


def _ordered(v: np.ndarray, i: np.ndarray) -> np.ndarray:
    return np.lexsort((i, v))


def ranks(measures: DataFrame, read: Callable[[dict], dict[str, np.ndarray]], wanted: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """Rows before each wanted (value, id), in order of (value, id) over all rows."""
    orders = {name: _ordered(*w) for name, w in wanted.items()}
    n = counted_places(measures, read, {name: (v[orders[name]], i[orders[name]]) for name, (v, i) in wanted.items()})
    out = {}
    for name, order in orders.items():
        out[name] = np.empty(len(order), np.int64)
        out[name][order] = np.cumsum(n[name])[:-1]
    return out


def quantiles(blobs: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation of columns over the rows that have them all, as ``percentile`` gives them."""

    def read(r: dict) -> dict[str, np.ndarray]:
        t = _read(r["data"])
        known = ~np.any([np.isnan(t[c]) for c in columns], axis=0)
        return {c: t[c][known] for c in ("id", *columns)}

    some = sampled(blobs, read, columns, max(1, round((blobs.agg(F.sum("n")).first()[0] or 0) / EDGES)))
    counts = counted_places(blobs, read, some)
    asked, wanted = [], defaultdict(set)
    for c in columns:
        upto = np.cumsum(counts[c])
        for q in qs:
            place = (upto[-1] - 1) * q
            spots = [(n, int(np.searchsorted(upto, n, side="right"))) for n in (math.floor(place), math.ceil(place))]
            asked.append((c, q, place, [(n - (int(upto[p - 1]) if p else 0), p) for n, p in spots]))
            wanted[c] |= {p for _, p in spots}

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            t = read(r)
            for c in columns:
                at = places(t[c], t["id"], *some[c])
                for p in wanted[c]:
                    v = t[c][at == p]
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(v), pa.string()), pa.array(np.full(len(v), p)), pa.array(v)], ["c", "p", "v"])

    found = blobs.mapInArrow(within, "c string, p long, v double").toPandas()  # a share of about 1/EDGES for each place
    runs = {key: np.sort(v.to_numpy()) for key, v in found.groupby(["c", "p"])["v"]}
    out = defaultdict(list)
    for c, _, place, ((i, p), (j, r)) in asked:
        x, y = float(runs[c, p][i]), float(runs[c, r][j])
        out[c].append(x if x == y else (math.ceil(place) - place) * x + (place - math.floor(place)) * y)
    return dict(out)


def sampled(frame: DataFrame, read: Callable[[dict], dict[str, np.ndarray]], names: list[str], every: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """About one of ``every`` rows as (value, id) pairs in order, for each measure. They steer the load, never a result."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            t = read(r)
            at = np.random.default_rng(r["part"] + 1).random(len(t["id"])) < 1 / every
            yield pa.RecordBatch.from_arrays([pa.array(t[c][at]) for c in ("id", *names)], ["id", *names])

    t = frame.mapInArrow(some, "id long, " + ", ".join(f"{c} double" for c in names)).toPandas()
    out = {}
    for c in names:
        order = _ordered(t[c].to_numpy(float), t["id"].to_numpy(np.int64))
        out[c] = t[c].to_numpy(float)[order], t["id"].to_numpy(np.int64)[order]
    return out


def _positions(t: dict[str, np.ndarray], value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows with a position and a value, where each position's begin, and how many it has."""
    rows = np.flatnonzero(~np.isnan(t["x"]) & ~np.isnan(t[value]))
    x, y = t["x"][rows], t["y"][rows]
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)])
    return rows, first, np.diff(np.append(first, len(x)))


def at_one_position(t: dict[str, np.ndarray], value: str, k: int, mean: float, spread: float) -> dict[str, np.ndarray]:
    """Measures of the rows whose k nearest others are at their own position, the first k by id."""
    rows, first, many = _positions(t, value)
    v, ids = t[value][rows], t["id"][rows]
    group, z = np.repeat(np.arange(len(many)), many), (v - mean) / spread
    full = first[many > k]
    spots = full[:, None] + np.arange(k + 1)
    around = np.zeros((2, len(full), k + 2))
    for m, c in enumerate((v, z)):
        near = c[spots]
        around[m, :, k + 1] = near[:, :k].sum(axis=1) / k
        for e in range(k + 1):
            around[m, :, e] = np.delete(near, e, axis=1).sum(axis=1) / k
    own = np.flatnonzero((many > k)[group])
    slot = (np.cumsum(many > k) - 1)[group[own]]
    place = np.minimum(own - first[group[own]], k + 1)
    radius = 1e-9
    return {"id": ids[own], "residual": np.abs(v[own] - around[0, slot, place]), "moran": np.abs(z[own] * around[1, slot, place]), "density": np.full(len(own), k / (math.pi * radius * radius))}


def _firsts(blobs: DataFrame, value: str, k: int, only: np.ndarray | None = None) -> DataFrame:
    """(id, x, y, v, asks): the rows that can be among the k nearest of another, the first k + 1 by id of each position, those of ``only`` if given; ``asks`` where a position has no more."""
    sent = blobs.sparkSession.sparkContext.broadcast(only)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            t = _read(r["data"])
            rows, first, many = _positions(t, value)
            place = np.arange(len(rows)) - np.repeat(first, many)
            keep = place <= k
            if sent.value is not None:
                keep &= np.isin(t["id"][rows], sent.value)
            at, asks = rows[keep], np.repeat(many <= k, many)[keep]
            for s in range(0, len(at), 65_536):
                a = at[s : s + 65_536]
                yield pa.RecordBatch.from_arrays([*[pa.array(t[c][a]) for c in ("id", "x", "y", value)], pa.array(asks[s : s + 65_536])], ["id", "x", "y", "v", "asks"])

    return blobs.select("data").mapInArrow(firsts, "id long, x double, y double, v double, asks boolean")


def lonely_edges(blobs: DataFrame, value: str, k: int) -> DataFrame | None:
    """(i, j, d) of the k nearest others of the rows at positions with at most k others, None where there is no such row."""

    def lonely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            many = _positions(_read(r["data"]), value)[2]
            yield pa.RecordBatch.from_arrays([pa.array([int(many[many <= k].sum())])], ["n"])

    if not blobs.select("data").mapInArrow(lonely, "n long").agg(F.sum("n")).first()[0]:
        return None
    return cut(neighbours.knn(_firsts(blobs, value, k), k, asks="asks").select("i", "j", "d"))


def among(blobs: DataFrame, value: str, k: int, mean: float, spread: float, edges: DataFrame | None) -> tuple[DataFrame, Callable[[dict], dict[str, np.ndarray]]]:
    """Blobs, and how to read (id, residual, moran, density) of the rows with a position and a value: the gap to the mean of the k nearest others, the
    product of the standardized value and their mean, and how many there are within the distance of the last.

    Rows at one position with more than k others are judged in place, as no row further away counts; the rest have ``edges``.
    """

    def read(r: dict) -> dict[str, np.ndarray]:
        t = _read(r["data"])
        return t if r["kind"] == OTHER else at_one_position(t, value, k, mean, spread)

    if edges is None:
        return blobs, read
    few = edges.count() <= MOST_CANDIDATES
    points = cut(_firsts(blobs, value, k, np.unique(np.concatenate([edges.select(c).toArrow()[c].to_numpy() for c in "ij"])) if few else None))
    z = (F.col("v") - F.lit(mean)) / F.lit(spread)
    near = edges.join(points.select(F.col("id").alias("j"), "v"), "j").groupBy(F.col("i").alias("id")).agg(F.avg("v").alias("m"), F.avg(z).alias("lag"), F.greatest(F.max("d"), F.lit(1e-9)).alias("r"), F.count("*").alias("k"))
    told = near.join(points.select("id", "v"), "id").select("id", F.abs(F.col("v") - F.col("m")).alias("residual"), F.abs(z * F.col("lag")).alias("moran"), (F.col("k") / (F.lit(math.pi) * F.col("r") * F.col("r"))).alias("density"))
    return blobs.unionByName(blobbed(told)), read


def blobbed(rows: DataFrame) -> DataFrame:
    """Rows in blobs as they come, materialised."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, n = [], 0
        for b in batches:
            mine.append(b)
            n += b.num_rows
            if n >= GATHERED // 3:
                t = pa.Table.from_batches(mine)
                yield _row(-1, OTHER, n, [], _blob({c: t[c].to_numpy() for c in t.column_names}))
                mine, n = [], 0
        if n:
            t = pa.Table.from_batches(mine)
            yield _row(-1, OTHER, n, [], _blob({c: t[c].to_numpy() for c in t.column_names}))

    return cut(rows.mapInArrow(packed, BLOB))


def boxes(cells: Cells, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the cells, infinite at the outside."""
    low, high = np.full((cells.count, dims), -np.inf), np.full((cells.count, dims), np.inf)
    stack = [(0, np.full(dims, -np.inf), np.full(dims, np.inf))]
    while stack:
        node, a, b = stack.pop()
        axis, at, left, right = cells.nodes[node]
        if axis < 0:
            low[left], high[left] = a, b
            continue
        upper, lower = b.copy(), a.copy()
        upper[axis] = lower[axis] = at
        stack += [(left, a, upper), (right, lower, b)]
    return low, high


def _vectors(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different vectors in order, their rows, and the vector of each row; rows are in order of their vectors."""
    f = np.stack([t["f0"], t["f1"], t["f2"]], axis=1)
    new = np.append(True, (f[1:] != f[:-1]).any(axis=1))[: len(f)]
    first = np.flatnonzero(new)
    return f[first], np.diff(np.append(first, len(f))), np.cumsum(new) - 1


def local_factors(blobs: DataFrame, value: str, k: int, n: int, scale: list[tuple[float, float]]) -> DataFrame | None:
    """Blobs of (id, lof) of the n rows with a position and a value, over position and value less the first of ``scale`` divided by the second.

    None for tables whose parts don't fit in a task or hang on too many vectors outside them.
    """
    spark = blobs.sparkSession
    count = -(-n // TILE_ROWS)
    every = max(1, n // (count * PER_TILE))
    fields = ["f0", "f1", "f2"]

    def scaled(data: bytes, step: int = 1) -> dict[str, np.ndarray]:
        t = _read(data)
        rows = np.flatnonzero(~np.isnan(t["x"]) & ~np.isnan(t[value]))[step // 2 :: step]
        return {"id": t["id"][rows], **{f: (t[c][rows] - a) / b + 0.0 for f, c, (a, b) in zip(fields, ("x", "y", value), scale)}}

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            t = scaled(r["data"], every)
            yield pa.RecordBatch.from_arrays([pa.array(t[f]) for f in fields], fields)

    sample = np.zeros((1, 3))
    if count > 1:
        sample = blobs.select("data").mapInArrow(some, "f0 double, f1 double, f2 double").toPandas()[fields].to_numpy(float)
        sample = sample[np.lexsort(sample.T[::-1])]
    cells = Cells(sample, PER_TILE)
    tasks = cells.count
    low, high = boxes(cells, 3)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            t = scaled(r["data"])
            tile = cells.of(np.stack([t[f] for f in fields], axis=1))
            order = np.argsort(tile, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(tile[order]) != 0, len(tile) > 0)) + 1
            for a, b in zip(np.append(0, ends[:-1]), ends):
                yield _row(int(tile[order[a]]), OWN, int(b - a), [], _blob({c: v[order[a:b]] for c, v in t.items()}))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches).items():
            rows_of = sum(r["n"] for r in rows)
            if rows_of > HELD_ROWS:
                yield _row(part, LOOSE, rows_of, [], b"")
                continue
            t = _joined([_read(r["data"]) for r in rows])
            order = np.lexsort((t["id"], t["f2"], t["f1"], t["f0"]))
            t = {c: v[order] for c, v in t.items()}
            x, w, _ = _vectors(t)
            far = []
            for v in x[:: max(1, len(x) // PER_TILE)] if tasks > 1 else ():
                d = ((x - v) ** 2).sum(axis=1)
                near = np.sort(np.partition(d, min(k, len(d) - 1))[: k + 1])
                far.append(near[-1])
            yield _row(part, OWN, rows_of, [float(np.sqrt(np.quantile(far, 0.99))) if far else 0.0], _blob(t))

    own = cut(blobs.select("data").mapInArrow(place, BLOB).repartitionById(tasks, F.col("part")).mapInArrow(gather, BLOB))
    swept(spark)
    known = own.select("part", "kind", "told").collect()
    if any(r["kind"] == LOOSE for r in known):
        return None
    reach = np.zeros(tasks)
    for r in known:
        reach[r["part"]] = 3.2 * r["told"][0]
    first = _judged(own, low - reach[:, None], high + reach[:, None], None, k, tasks)
    rest = first.where(F.col("kind") == UNSURE).agg(F.sum("n").alias("n"), F.max(F.element_at("told", 1)).alias("r")).first()
    if rest["n"]:
        if rest["n"] > MOST_UNSURE or math.isinf(rest["r"]):
            return None
        t = _joined([_read(r["data"]) for r in first.where(F.col("kind") == UNSURE).select("data").collect()])
        order = np.lexsort((t["id"], t["f2"], t["f1"], t["f0"]))
        t = {c: v[order] for c, v in t.items()}
        x, _, at = _vectors(t)
        kd = np.zeros(len(x))
        kd[at] = t["r"]
        size = np.floor(np.log2(np.maximum(kd, 1e-300)))
        groups = []
        for s in np.unique(size):
            mine = np.flatnonzero(size == s)
            cell = Cells(x[mine], GROUP).of(x[mine])
            groups += [mine[cell == c] for c in np.unique(cell)]
        far = [factor.REACH * kd[g].max() * (1 + 1e-9) for g in groups]
        wide = np.stack([x[g].min(axis=0) - r for g, r in zip(groups, far)]), np.stack([x[g].max(axis=0) + r for g, r in zip(groups, far)])
        wanted = [{c: v[np.isin(at, g)] for c, v in t.items()} for g in groups]
        second = _judged(own, *wide, wanted, k, len(groups))
        if second.where(F.col("kind") == UNSURE).count():
            return None
        first = first.where(F.col("kind") == SURE).unionByName(second)
    return first


def _judged(own: DataFrame, low: np.ndarray, high: np.ndarray, wanted: list[dict[str, np.ndarray]] | None, k: int, tasks: int) -> DataFrame:
    """Blobs of (id, lof) that are sure, and of (id, vector, r) that are not, of the rows of each box: those of its own part, or the wanted ones."""
    sent = own.sparkSession.sparkContext.broadcast((low, high, wanted))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, wanted = sent.value
        for r in _each(batches):
            t = _read(r["data"])
            if wanted is None:
                yield _row(r["part"], OWN, r["n"], [], r["data"])
            x, w, _ = _vectors(t)
            if not len(x):
                continue
            ends = x.min(axis=0), x.max(axis=0)
            for to in np.flatnonzero(((low <= ends[1]) & (high >= ends[0])).all(axis=1)):
                if wanted is None and to == r["part"]:
                    continue
                a, b = np.searchsorted(x[:, 0], low[to, 0]), np.searchsorted(x[:, 0], high[to, 0], side="right")
                at = a + np.flatnonzero(((x[a:b] >= low[to]) & (x[a:b] <= high[to])).all(axis=1))
                if len(at):
                    yield _row(int(to), OTHER, len(at), [], _blob({"f0": x[at, 0], "f1": x[at, 1], "f2": x[at, 2], "w": w[at].astype(np.int32)}))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, wanted = sent.value
        for part, rows in _by_part(batches).items():
            mine = _read(next(r["data"] for r in rows if r["kind"] == OWN)) if wanted is None else wanted[part]
            x, w, vector = _vectors(mine)
            more = [_read(r["data"]) for r in rows if r["kind"] == OTHER]
            more = _joined(more) if more else None
            every = np.concatenate([x, np.stack([more[f] for f in ("f0", "f1", "f2")], axis=1)]) if more and wanted is None else x if not more else np.stack([more[f] for f in ("f0", "f1", "f2")], axis=1)
            n = np.concatenate([w, more["w"]]) if more and wanted is None else w if not more else more["w"]
            order = np.lexsort(every.T[::-1])
            every, n = every[order], n[order].astype(np.int64)
            if wanted is None:
                core = np.empty(len(order), np.int64)
                core[order] = np.arange(len(order))
                core = core[: len(x)]
            else:  # both are in order
                both = np.concatenate([every, x])
                core = np.unique(both, axis=0, return_inverse=True)[1].ravel()[len(every) :]
            lof, sure, r = factor.factors(every, n, k, low[part], high[part], core)
            good = sure[vector]
            if good.any():
                yield _row(part, SURE, int(good.sum()), [], _blob({"id": mine["id"][good], "lof": lof[vector][good]}))
            if not good.all():
                left = {c: mine[c][~good] for c in ("id", "f0", "f1", "f2")} | {"r": r[vector][~good]}
                yield _row(part, UNSURE, int((~good).sum()), [float(left["r"].max())], _blob(left))

    out = cut(own.mapInArrow(send, BLOB).repartitionById(tasks, F.col("part")).mapInArrow(judge, BLOB))
    sent.unpersist()
    swept(own.sparkSession)
    return out


def high_scores(near: tuple[DataFrame, Callable[[dict], dict[str, np.ndarray]]], lofs: Callable[[], DataFrame], n: int, weights: dict[str, float], least: float) -> int | None:
    """How many of n rows have a weighted sum of ranks (density, residual, lof, moran; 0..n-1 in order of (value, id), scaled to 0..1) of ``least`` or more; None for too many that might.

    Rows that can't reach it with the highest rank in what is not known yet are left out; the ranks of the others are counted over all rows.
    """
    if n < 2 or sum(weights.values()) < least:
        return int(n == 1 and least <= 0)
    frame, read = near
    names = ["density", "residual", "moran"]
    slack = 1e-9
    ends = sampled(frame, read, names, max(1, n // EDGES))
    upto = {c: (np.cumsum(v) - 1) / (n - 1) for c, v in counted_places(frame, read, ends).items()}
    sent = frame.sparkSession.sparkContext.broadcast((ends, upto))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, upto = sent.value
        for r in _each(batches):
            t = read(r)
            most = np.full(len(t["id"]), weights["lof"])
            for c in names:
                most += weights[c] * upto[c][places(t[c], t["id"], *ends[c])]
            at = np.flatnonzero(most >= least - slack)
            yield _row(-1, OTHER, len(at), [], _blob({c: t[c][at] for c in ("id", *names)}))

    may = cut(frame.mapInArrow(possible, BLOB))
    sent.unpersist()
    if may.agg(F.sum("n")).first()[0] > MOST_CANDIDATES:
        return None
    t = _joined([_read(r["data"]) for r in may.select("data").collect()])
    r = {c: v / (n - 1) for c, v in ranks(frame, read, {c: (t[c], t["id"]) for c in names}).items()}
    good = sum(weights[c] * r[c] for c in names) + weights["lof"] >= least - slack
    ids, r = t["id"][good], {c: v[good] for c, v in r.items()}
    order = np.argsort(ids)
    ids, r = ids[order], {c: v[order] for c, v in r.items()}
    made = lofs()
    chosen = made.sparkSession.sparkContext.broadcast(ids)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(batches):
            f = _read(b["data"])
            at = np.minimum(np.searchsorted(chosen.value, f["id"]), max(len(chosen.value) - 1, 0))
            hit = chosen.value[at] == f["id"] if len(chosen.value) else np.zeros(len(at), bool)
            yield pa.RecordBatch.from_arrays([pa.array(f["id"][hit]), pa.array(f["lof"][hit])], ["id", "lof"])

    found = made.select("data").mapInArrow(look_up, "id long, lof double").toArrow()
    lof = np.empty(len(ids))
    lof[np.searchsorted(ids, found["id"].to_numpy())] = found["lof"].to_numpy()
    r["lof"] = ranks(made.select("data"), lambda b: _read(b["data"]), {"lof": (lof, ids)})["lof"] / (n - 1)
    score = weights["density"] * r["density"] + weights["residual"] * r["residual"] + weights["lof"] * r["lof"] + weights["moran"] * r["moran"]
    return int((score >= least).sum())
