"""Percentiles with multiplicative rank error, from sketches that merge across days, files and partitions.

A sketch is a pile of relative compactors (Cormode, Karnin, Liberty, Thaler, Vesely 2021). A compactor holds values of one
weight in sections; when full, it sorts them and sends every other one of the unprotected end up a level with twice the weight.
How many sections take part follows the trailing ones of a counter, so values near the protected end are compacted ever more
rarely: the rank error at quantile q is a small share of 1-q where the upper tail is protected, of q where the lower one is.
Every group has a sketch for each tail, and percentiles below the median are taken from the lower one; up to EXACT values
are kept as they are, for both tails at once. Sketches of separate parts merge level by level into a sketch of the whole with the same bound.

Building is a map over the input (one sketch per partition and group, no shuffle of values); merging goes in two steps,
first over a bounded number of partitions, then over these, so no task meets all sketches of a group. A task that holds
HELD groups writes them out and goes on with new ones. Coins are drawn from a hash of the values that are compacted and of the
partition, so that equal parts throw different coins and a rerun of a lost task gives the same sketch.

Defined cases: NULL, NaN and infinite values are left out; NULL groups are groups; a group without values gives no row;
up to EXACT values a sketch is exact; q outside 0..1 is an error; ties count by their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.common import skew_join

K = 32
SECTIONS = 3
MERGE_FAN = 32
HELD = 65_536
EXACT = 2 * SECTIONS * K
#: Relative and additive standard errors of the sketch, as measured for and published with the Apache DataSketches REQ sketch.
RELATIVE, ADDITIVE, DEVIATIONS = 0.0512, 0.084, 4
SKETCH = "upper boolean, n long, low double, high double, states array<long>, sections array<int>, sizes array<int>, items array<double>"


class Compactor:
    __slots__ = ("k", "sections", "state", "buf", "used", "section_size")

    def __init__(self, k: int, sections: int = SECTIONS, state: int = 0, items: np.ndarray | None = None) -> None:
        self.k, self.sections, self.state = k, sections, state
        self.buf = [] if items is None or not len(items) else [items]
        self.used = 0 if items is None else len(items)

    @property
    def capacity(self) -> int:
        return 2 * self.sections * self.section

    @property
    def section(self) -> int:
        """Sections get smaller by sqrt(2) whenever their number is doubled, and stay even."""
        doubled = int(round(np.log2(self.sections / SECTIONS)))
        return max(4, int(round(self.k / 2 ** (doubled / 2) / 2)) * 2)

    def add(self, items: np.ndarray) -> None:
        if len(items):
            self.buf.append(items)
            self.used += len(items)

    def values(self) -> np.ndarray:
        v = np.sort(np.concatenate(self.buf)) if self.buf else np.empty(0)
        self.buf = [v]
        return v

    def compact(self, coin: int, upper: bool) -> np.ndarray:
        """Every other value of the unprotected end; the protected half and the sections not due stay."""
        v = self.values()
        ones = (~self.state & (self.state + 1)).bit_length() - 1
        keep = self.capacity // 2 + (self.sections - min(ones + 1, self.sections)) * self.section
        n = len(v) - keep
        n -= n % 2
        part, rest = (v[:n], v[n:]) if upper else (v[len(v) - n :], v[: len(v) - n])
        self.buf, self.used = [rest], len(rest)
        self.state += 1
        if self.state >= 1 << (self.sections - 1) and self.section > 4:
            self.sections *= 2
        return part[coin::2]


class Sketch:
    """Relative-error quantile sketch; upper=True keeps large values exact, else small ones; None for values as they are."""

    def __init__(self, k: int = K, upper: bool | None = True, seed: int = 0) -> None:
        self.k, self.upper, self.seed = k, upper, seed
        self.n, self.low, self.high = 0, np.inf, -np.inf
        self.levels = [Compactor(k)]

    def _coin(self, level: int) -> int:
        held = self.levels[level]
        x = (crc32(held.values().tobytes(), level) * 0x9E3779B97F4A7C15 + (self.n + held.state) * 0xC2B2AE3D27D4EB4F + self.seed) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 31)) * 0x94D049BB133111EB >> 61 & 1

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            while self.levels[h].used > self.levels[h].capacity:
                if h + 1 == len(self.levels):
                    self.levels.append(Compactor(self.k))
                up = self.levels[h].compact(self._coin(h), self.upper)
                if not len(up):
                    break
                self.levels[h + 1].add(up)
            h += 1

    def update(self, values: np.ndarray, step: int = 4_096) -> None:
        values = values[np.isfinite(values)]
        if not len(values):
            return
        self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        for s in range(0, len(values), step):
            part = values[s : s + step]
            self.n += len(part)
            self.levels[0].add(part)
            self._settle()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        while len(self.levels) < len(other.levels):
            self.levels.append(Compactor(self.k))
        for mine, theirs in zip(self.levels, other.levels):
            mine.state |= theirs.state
            mine.sections = max(mine.sections, theirs.sections)
            mine.add(theirs.values())
        self._settle()

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Values in order and the number of input values each stands for."""
        v = np.concatenate([c.values() for c in self.levels])
        w = np.concatenate([np.full(c.used, 1 << h, np.int64) for h, c in enumerate(self.levels)])
        order = np.argsort(v, kind="stable")
        return v[order], w[order]

    def quantiles(self, qs: list[float]) -> np.ndarray:
        """Smallest kept value whose rank reaches q*n; 0 and 1 are the exact extremes."""
        v, w = self.weighted()
        if not len(v):
            return np.full(len(qs), np.nan)
        at = np.searchsorted(np.cumsum(w), np.ceil(np.array(qs) * self.n).clip(1), side="left")
        out = v[at.clip(max=len(v) - 1)]
        return np.where(np.array(qs) <= 0, self.low, np.where(np.array(qs) >= 1, self.high, out))

    def exact(self) -> bool:
        return len(self.levels) == 1

    def rank_error(self, q: float) -> float:
        """Bound, at about 4 standard deviations, of the difference between q and the true rank share of the value returned."""
        if self.exact():
            return 0.0
        tail = 1 - q if self.upper else q
        return DEVIATIONS * min(np.sqrt(RELATIVE / SECTIONS) * tail, ADDITIVE) / self.k + 1 / self.n

    def row(self) -> tuple:
        parts = [c.values() for c in self.levels]
        return self.upper, self.n, self.low, self.high, [c.state for c in self.levels], [c.sections for c in self.levels], [len(p) for p in parts], np.concatenate(parts)

    @classmethod
    def of(cls, row: dict, k: int) -> Sketch:
        s = cls(k, row["upper"])
        s.n, s.low, s.high = row["n"], row["low"], row["high"]
        items, at = np.asarray(row["items"], float), np.append(0, np.cumsum(row["sizes"]))
        s.levels = [Compactor(k, int(c), int(st), items[a:b]) for c, st, a, b in zip(row["sections"], row["states"], at[:-1], at[1:])]
        return s


class Pair:
    """The values of a group: as they are while few, then a sketch for each tail."""

    __slots__ = ("k", "seed", "n", "raw", "tails")

    def __init__(self, k: int = K, seed: int = 0) -> None:
        self.k, self.seed, self.n = k, seed, 0
        self.raw: list[np.ndarray] = []
        self.tails: dict[bool, Sketch] = {}

    def _split(self) -> None:
        held = np.concatenate(self.raw) if self.raw else np.empty(0)
        self.tails = {upper: Sketch(self.k, upper, self.seed) for upper in (True, False)}
        for t in self.tails.values():
            t.update(held)
        self.raw = []

    def add(self, values: np.ndarray) -> None:
        if self.tails:
            for t in self.tails.values():
                t.update(values)
            return
        self.n += len(values)
        self.raw.append(values)
        if self.n > EXACT:
            self._split()

    def merge(self, part: Sketch) -> None:
        if part.upper is None:
            self.add(part.levels[0].values())
            return
        if not self.tails:
            self._split()
        self.tails[part.upper].merge(part)

    def rows(self) -> list[tuple]:
        if self.tails:
            return [t.row() for t in self.tails.values() if t.n]
        if not self.n:
            return []
        v = np.sort(np.concatenate(self.raw))
        return [(None, len(v), float(v[0]), float(v[-1]), [0], [SECTIONS], [len(v)], v)]


def _emit(found: dict[tuple, Pair], schema: pa.Schema, step: int = 2_000) -> Iterator[pa.RecordBatch]:
    rows = [(*key, *row) for key, pair in found.items() for row in pair.rows()]
    for s in range(0, len(rows), step):
        cols = list(zip(*rows[s : s + step]))
        yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(cols)], schema=schema)


def _sketches(b: pa.RecordBatch, k: int) -> Iterator[Sketch]:
    """The sketches of a batch; their arrays are views of the batch."""
    n, low, high = (b[c].to_numpy() for c in ("n", "low", "high"))
    lists = {c: (b[c].values.to_numpy(), b[c].offsets.to_numpy()) for c in ("states", "sections", "sizes", "items")}
    for i, upper in enumerate(b["upper"].to_pylist()):
        cells = {c: v[o[i] : o[i + 1]] for c, (v, o) in lists.items()}
        yield Sketch.of({"upper": upper, "n": int(n[i]), "low": float(low[i]), "high": float(high[i]), **cells}, k)


def _schema(df: DataFrame, by: list[str], extra: str = "") -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by], *([extra] if extra else []), SKETCH])
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def build(values: DataFrame, by: list[str], value: str, k: int = K, ways: list[list[str]] | None = None) -> DataFrame:
    """Sketches of both tails of ``value`` per group of ``by`` and partition; merge them with ``merge``.

    ways: groupings to make in the one pass, each a subset of ``by``; the columns left out of a way are NULL in its rows,
    and a column ``way`` tells them apart.
    """
    ways = ways or [by]
    ddl, schema = _schema(values, by, "way int, part int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Pair] = {}
        for b in batches:
            if not b.num_rows:
                continue
            part = b["__part"][0].as_py()
            v = b["__v"].to_numpy(zero_copy_only=False)
            coded = {}
            for c in by:
                d = b[c].dictionary_encode()
                coded[c] = (d.indices.fill_null(-1).to_numpy(zero_copy_only=False), [*d.dictionary.to_pylist(), None])
            for w, cols in enumerate(ways):
                code = np.zeros(len(v), np.int64)
                for c in cols:
                    code = code * len(coded[c][1]) + coded[c][0] % len(coded[c][1])
                order = np.argsort(code, kind="stable")
                edges = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
                for lo, hi in zip(edges, np.append(edges[1:], len(order))):
                    i = order[lo]
                    key = tuple(coded[c][1][coded[c][0][i]] if c in cols else None for c in by) + (w, part)
                    if key not in found:
                        found[key] = Pair(k, part)
                    found[key].add(v[order[lo:hi]])
                if len(found) >= HELD:
                    yield from _emit(found, schema)
                    found = {}
        yield from _emit(found, schema)

    v = F.col(value).cast("double")
    rows = values.select(*by, v.alias("__v"), F.spark_partition_id().alias("__part")).where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") != float("inf")))
    return rows.mapInArrow(run, ddl)


def merge(sketches: DataFrame, by: list[str], k: int = K, fan: int = MERGE_FAN) -> DataFrame:
    """One sketch per group of ``by`` and tail, in two steps; other columns are dropped. Works on any rows that hold the sketch columns."""
    ddl, schema = _schema(sketches, by)
    fields = [f.split()[0] for f in SKETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Pair] = {}
        last = None
        for b in batches:
            keys = zip(*[b[c].to_pylist() for c in by]) if by else [()] * b.num_rows
            for key, sketch in zip(keys, _sketches(b, k)):
                if key != last and len(found) >= HELD and key not in found:
                    yield from _emit(found, schema)
                    found = {}
                last = key
                if key not in found:
                    found[key] = Pair(k)
                found[key].merge(sketch)
        if found:
            yield from _emit(found, schema)

    part = F.col("part") if "part" in sketches.columns else F.spark_partition_id()
    first = sketches.select(*by, *fields, F.pmod(F.xxhash64(part), F.lit(fan)).cast("int").alias("__m"))
    first = first.repartition(*by, "__m").sortWithinPartitions(*by, "__m").drop("__m").mapInArrow(run, ddl)
    return first.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, ddl)


def percentiles(sketches: DataFrame, by: list[str], qs: list[float], k: int = K) -> DataFrame:
    """(by, n, q, value, rank_error): one row per group and q from merged sketches, q below 0.5 from those of the lower tail."""
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("q must be in 0..1")
    ddl = ", ".join([*[f"`{c}` {sketches.schema[c].dataType.simpleString()}" for c in by], "n long, q double, value double, rank_error double"])
    fields = [f.split()[0] for f in SKETCH.split(", ")]

    halves = {None: qs} | {upper: [q for q in qs if (q >= 0.5) == upper] for upper in (True, False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, q_of, value, error = [], [], [], []
            for i, s in enumerate(_sketches(b, k)):
                mine = halves[s.upper]
                row += [i] * len(mine)
                q_of += mine
                value += s.quantiles(mine).tolist()
                error += [s.rank_error(q) for q in mine]
            again = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b[c].take(again) for c in by], b["n"].take(again), *[pa.array(x, pa.float64()) for x in (q_of, value, error)]], [*by, "n", "q", "value", "rank_error"])

    return sketches.select(*by, *fields).mapInArrow(run, ddl)


def long_values(df: DataFrame, columns: list[str], keep: list[Column]) -> DataFrame:
    """(keep, field, v): several numeric columns as rows, missing and infinite values left out before anything moves."""
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns]
    rows = df.select(*keep, F.explode(F.array(*cells)).alias("x")).select(*[c for c in df.select(*keep).columns], "x.field", "x.v")
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))


def within(values: DataFrame, told: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """(by, q, within): whether each percentile of ``told`` lies within its reported error of the true rank, counted over all values."""
    counted = values.groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    cuts = told.groupBy(*by).agg(F.collect_list(F.struct("q", "value", "rank_error", "n")).alias("cuts"))
    met = skew_join(counted, cuts, by, "inner", F.col("__v")).select(*by, "__v", "__c", F.explode("cuts").alias("x"))
    ranks = met.groupBy(*by, "x").agg(F.sum(F.when(F.col("__v") < F.col("x.value"), F.col("__c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("__v") <= F.col("x.value"), F.col("__c")).otherwise(0)).alias("upto"))
    reach = F.col("x.rank_error") * F.col("x.n") + 1
    at = F.col("x.q") * F.col("x.n")
    return ranks.select(*by, F.col("x.q").alias("q"), ((F.col("below") <= at + reach) & (F.col("upto") >= at - reach)).alias("within"))
