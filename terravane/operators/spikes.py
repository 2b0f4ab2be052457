"""Implausible readings per source: outside the instrument's range, stuck, or spikes against the source's own behaviour.

Each field of each source is a series of its valid readings. Series are cut into blocks by their own running index, found
from counts per source and day or minute, so a source with a third of all rows is spread over many tasks; a block carries a halo of
the readings before and after it, and as NULL and NaN are left out before the index is taken, the halo always holds what
the checks look at. A series is decomposed robustly:

* the daily course of a source is the median, over all its blocks, of the detrended readings of each hour of the day
  (a first pass over the blocks gives their medians, these are combined per source, weighted by readings);
* the trend at a reading is what its neighbours show before it and after it (running medians of SIDE readings); the
  residual is the distance from the nearer of both, and 0 in between, so that a change that lasts leaves no residual;
* the usual scatter around a reading is a running median of absolute differences, which a change of level hardly touches.

Residuals in units of the scatter go through the generalised extreme studentised deviate test: the most extreme one is
removed, mean and standard deviation of the rest are estimated again, and all up to the last step past its limit are
outliers. As many steps are made as there are residuals past LOOK scatters, so none that could be a case is left out. An
outlier is a case if it also passes RATIO scatters, stands between jumps, and at most two neighbours go with it. Fields with heavy
tails have to be outliers on the log scale as well.

Defined cases: NULL and NaN are no readings; readings without a readable time come first in their day; repeated
deliveries (all columns equal but row_id and received_at) are one reading and are reported row by row; products without
limits have no range check; series of fewer than ``MIN_SERIES`` sound readings in a block show no usual behaviour and have no spike check; an
hour of the day with readings on fewer than COURSE_DAYS days has no course; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.common import by_group

BLOCK, HALO = 8_192, 96
STUCK = 12
SIDE, SCATTER, STRIDE = 11, 61, 8
#: Standard error of a scatter estimated from SCATTER differences of white noise, as a share of the scatter.
SCATTER_SE = 0.163
#: Ten times the usual scatter, where the estimate may be two standard errors too high.
RATIO = 10 / (1 + 2 * SCATTER_SE)
LOOK, LARGEST = 3.0, 1e6
LONGEST = 3
#: One false outlier in ten thousand series of ordinary readings.
ALPHA = 1e-4
MIN_SERIES = 8
COURSE_DAYS = 3
MAX_LIMITS = 10_000
HOT_SHARE = 1 / 512
NO_SOURCE = "\x00"
FIELDS = ("FRP", "BRIGHTNESS", "BRIGHT_T31")
LOG_FIELDS = ("FRP",)


@lru_cache(100_000)
def gesd_limit(n: int, i: int, alpha: float = ALPHA) -> float:
    """Critical value of the i-th step of the generalised ESD test for n values (Rosner 1983)."""
    v = n - i - 1
    if v < 1:
        return np.inf
    z = NormalDist().inv_cdf(1 - alpha / (2 * (n - i + 1)))
    t = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v)
    return (n - i) * t / np.sqrt((v + t * t) * (n - i + 1))


def _windows_median(x: np.ndarray, centres: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Median of x over [c+lo, c+hi] clipped to the series; NaN where fewer than three values are left."""
    at = centres[:, None] + np.arange(lo, hi + 1)[None, :]
    w = np.where((at >= 0) & (at < len(x)), x[np.clip(at, 0, len(x) - 1)], np.nan)
    w.sort(axis=1)
    n = (~np.isnan(w)).sum(axis=1)
    rows = np.arange(len(w))
    m = (w[rows, np.maximum(n - 1, 0) // 2] + w[rows, np.maximum(n, 1) // 2]) / 2
    m[n < 3] = np.nan
    return m


def _detrended(x: np.ndarray) -> np.ndarray:
    """x less the running median of 25 readings."""
    stops = np.unique(np.append(np.arange(0, len(x), STRIDE), len(x) - 1))
    return x - np.interp(np.arange(len(x)), stops, _windows_median(x, stops, -12, 12))


def hour_medians(x: np.ndarray, hour: np.ndarray, day: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(hour of the day, median of the detrended readings, their number, their days) of one block."""
    off = _detrended(x)
    out = []
    order = np.argsort(hour, kind="stable")
    cuts = np.searchsorted(hour[order], np.arange(25))
    for h, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if b > a:
            at = order[a:b]
            out.append((h, float(np.median(off[at])), int(b - a), len(np.unique(day[at]))))
    return out


def course_of(medians: list[tuple[int, float, int]]) -> np.ndarray:
    """Daily course by hour from (hour, median, days); the fewer days are known, the nearer to its neighbouring hours and to 0."""
    mid, days = np.zeros(24), np.zeros(24)
    for h, m, d in medians:
        if d >= COURSE_DAYS:
            mid[h], days[h] = m, d
    near = np.roll(days, 1) + 2 * days + np.roll(days, -1)
    smooth = np.roll(days * mid, 1) + 2 * days * mid + np.roll(days * mid, -1)
    known = days / (days + 4)
    return known * (mid + (1 - known) * (np.divide(smooth, near, out=np.zeros(24), where=near > 0) - mid))


def deviations(x: np.ndarray, course: np.ndarray, grain: float) -> tuple[np.ndarray, np.ndarray]:
    """Residuals in units of the local scatter, and which readings stand next to a jump. course: of each reading; grain: resolution of the readings."""
    n = len(x)
    x = x - course
    stops = np.unique(np.append(np.arange(0, n, STRIDE), n - 1))
    jump = np.abs(np.diff(x))
    floor = 0.5 * max(grain, 1e-9)
    rough = _windows_median(jump, stops, -(SCATTER // 2) - 1, SCATTER // 2) * 1.4826 / np.sqrt(2)
    whole = max(float(np.median(jump)) * 1.4826 / np.sqrt(2), floor)
    scatter = np.interp(np.arange(n), stops, np.where(np.isnan(rough), whole, np.maximum(rough, floor)))
    medians = _windows_median(x, np.arange(-SIDE, n + 1), 0, SIDE - 1)
    left, right = medians[:n], medians[SIDE + 1 :]
    left, right = np.where(np.isnan(left), right, left), np.where(np.isnan(right), left, right)
    a, b = x - left, x - right
    residual = np.where(a * b > 0, np.where(np.abs(a) < np.abs(b), a, b), 0.0)
    # a run of at most LONGEST readings that leaves both sides begins and ends with a jump
    big = np.flatnonzero(jump > LOOK * np.minimum(scatter[1:], scatter[:-1])) + 1
    near = np.zeros(n, bool)
    for k in range(-LONGEST - 1, LONGEST + 1):
        near[np.clip(big + k, 0, n - 1)] = True
    return np.clip(np.nan_to_num(residual / scatter), -LARGEST, LARGEST), near


def esd_outliers(u: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Outliers of the generalised ESD test: location and scale are estimated again after each removal."""
    hit = np.zeros(len(u), bool)
    most = min(int((np.abs(u) > LOOK).sum()), len(u) - 2)
    if most < 1:
        return hit
    order = np.argsort(u, kind="stable")
    v = u[order]
    total, squares = v.sum(), (v * v).sum()
    lo, hi, last = 0, len(v), 0
    gone = np.empty(most, np.int64)
    for i in range(1, most + 1):
        m = hi - lo
        mean = total / m
        spread = np.sqrt(max((squares - m * mean * mean) / (m - 1), 1e-12))
        if v[hi - 1] - mean >= mean - v[lo]:
            hi -= 1
            k = hi
        else:
            k = lo
            lo += 1
        gone[i - 1] = k
        if abs(v[k] - mean) / spread > gesd_limit(len(v), i, alpha):
            last = i
        total -= v[k]
        squares -= v[k] * v[k]
    hit[order[gone[:last]]] = True
    return hit


def runs(v: np.ndarray) -> np.ndarray:
    """Length of the run of equal values each value stands in."""
    new = np.append(True, v[1:] != v[:-1])
    group = new.cumsum()
    return np.bincount(group)[group]


def unsound(v: np.ndarray, low: np.ndarray | float, high: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Readings out of range, infinite ones included, and readings that are stuck."""
    return ~np.isfinite(v) | (v < low) | (v > high), runs(v) >= STUCK


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, x[x > 0].min() if (x > 0).any() else 1.0))


def scales(x: np.ndarray, log: bool) -> list[np.ndarray]:
    return [x, _log(x)] if log else [x]


def block_medians(v: np.ndarray, hour: np.ndarray, day: np.ndarray, low: np.ndarray | float, high: np.ndarray | float, log: bool, own: np.ndarray | None = None) -> list[list[tuple[int, float, int, int]]]:
    """``hour_medians`` of the sound readings of a block, per scale; own: without the halo."""
    out, stuck = unsound(v, low, high)
    good = ~out & ~stuck if own is None else ~out & ~stuck & own
    if not good.any():
        return [[] for _ in range(1 + log)]
    return [hour_medians(x, hour[good], day[good]) for x in scales(v[good], log)]


def flag_series(v: np.ndarray, hour: np.ndarray, day: np.ndarray, low: np.ndarray | float, high: np.ndarray | float, log: bool, ratio: float = RATIO, courses: list[np.ndarray] | None = None, spikes: bool = True) -> np.ndarray:
    """Cases in one series of readings in order; infinite values are readings, NaN must be left out before.

    courses: daily course per scale, from the series itself where none is given.
    """
    out, stuck = unsound(v, low, high)
    sound = np.flatnonzero(~out & ~stuck)
    hit = out | stuck
    if spikes and len(sound) >= MIN_SERIES:
        x, h = v[sound], hour[sound]
        courses = courses or [course_of([(k, m, d) for k, m, _, d in found]) for found in block_medians(v, hour, day, low, high, log)]
        deviant, first = np.ones(len(x), bool), True
        for y, course in zip(scales(x, log), courses):
            steps = np.diff(np.unique(y))
            u, near = deviations(y, course[h], float(steps[steps > 1e-9].min()) if (steps > 1e-9).any() else 0.0)
            deviant &= esd_outliers(u) & near
            if first:
                deviant &= np.abs(u) > ratio
            first = False
            if not deviant.any():
                break
        if deviant.any():
            group = np.append(0, np.cumsum(deviant[1:] != deviant[:-1]))
            hit[sound[deviant & (np.bincount(group)[group] <= LONGEST)]] = True
    return hit


def minute_of_day(text: Column) -> Column:
    """HHMM spelled 0339, 339, 339.0, 9 or 9.0; NULL if unreadable."""
    digits = F.regexp_extract(text, r"^\s*(\d{1,4})(?:\.0*)?\s*$", 1).try_cast("int")
    return F.when((digits % 100 < 60) & (digits < 2400), (F.floor(digits / 100) * 60 + digits % 100).cast("int"))


def readings(rows: DataFrame, products: list[str], source: str, product: str, day: str, time: str, row_id: str, fields: tuple[str, ...], aside: tuple[str, ...]) -> DataFrame:
    """The rows with what tells readings apart: source, product (its place in ``products``, 0 for others), bin (hour), minute, fields, h, row_id.

    h is a hash of all columns but row_id and ``aside``; it only has to tell rows apart that agree in all the rest. NULLs
    are hashed by their place, so a value in another column is another row.
    """
    content = [c for c in rows.columns if c != row_id and c not in aside]
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in content])
    minute = F.coalesce(minute_of_day(F.col(time)), F.lit(-1))
    days = F.coalesce(F.datediff(F.col(day).cast("date"), F.lit("1970-01-01")), F.lit(-1_000_000))
    code = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in products]).cast("array<string>"), F.col(product).cast("string")), F.lit(0)).cast("int")
    return rows.select(
        F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("source"), code.alias("product"),
        F.coalesce((days * 24 + F.greatest(F.floor(minute / 60), F.lit(0))).cast("int"), F.lit(0)).alias("bin"), minute.alias("minute"),
        *[F.col(f).cast("double").alias(f) for f in fields], F.xxhash64(nulls, *[F.col(f"`{c}`") for c in content]).alias("h"), F.col(row_id).alias("row_id"),
    )


def flag(rows: DataFrame, limits: DataFrame, source: str = "_source_file", product: str = "_api_source", day: str = "ACQ_DATE", time: str = "ACQ_TIME", row_id: str = "row_id", fields: tuple[str, ...] = FIELDS, log_fields: tuple[str, ...] = LOG_FIELDS, aside: tuple[str, ...] = ("received_at",), block: int = BLOCK, spikes: bool = True) -> DataFrame:
    """(row_id, field_name) of every delivered row and field that is a case. limits: (api_source, field_name, low_value, high_value), at most MAX_LIMITS rows.

    spikes=False makes only the range and run checks.
    """
    listed = limits.where("api_source is not null").limit(MAX_LIMITS + 1).collect()
    if len(listed) > MAX_LIMITS:
        raise ValueError("the table of limits is meant to be small")
    products = sorted({r["api_source"] for r in listed})
    bounds = {(r["api_source"], r["field_name"]): (r["low_value"], r["high_value"]) for r in listed}

    every = readings(rows, products, source, product, day, time, row_id, fields, aside)
    one = every.groupBy("source", "product", "bin", "minute", *fields, "h").agg(F.min("row_id").alias("rid"), F.count("*").alias("n"))
    valid = {f: F.col(f).isNotNull() & ~F.isnan(f) for f in fields}
    # running numbers are counted in cells of a day, of a minute for sources with more than HOT_SHARE of the rows (at most 1/HOT_SHARE sources)
    counted = rows.groupBy(F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("hot")).agg(F.count("*").alias("c"))
    total = counted.agg(F.sum("c").alias("t"))
    hot = F.broadcast(counted.where(F.col("c") > total.scalar() * F.lit(HOT_SHARE)).select("hot"))
    fine = F.col("bin") * 60 + F.greatest(F.pmod(F.col("minute"), F.lit(60)), F.lit(0))
    cell = F.when(F.col("hot").isNotNull(), fine).otherwise((F.col("bin") - F.pmod(F.col("bin"), F.lit(24))) * 60)
    cell = F.coalesce(cell, F.lit(0)).alias("cell")
    tied = one.join(hot, F.col("source") == F.col("hot"), "left")
    # rows and counts use the same columns in the same order, so that both read one exchange
    bins = tied.select("rid", "source", cell, *fields, "n").groupBy("source", "cell").agg(F.min("rid").alias("some"), F.max("n").alias("most"), *[F.count_if(valid[f]).alias(f"n_{f}") for f in fields])
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select("source", "cell", "some", "most", *[F.coalesce(F.sum(f"n_{f}").over(before), F.lit(0)).alias(f"o_{f}") for f in fields])
    along = Window.partitionBy("source", "cell").orderBy("bin", "minute", "rid").rowsBetween(Window.unboundedPreceding, 0)
    slim = tied.select("rid", "source", cell, "product", "bin", "minute", *fields, F.when(F.col("n") > 1, F.col("h")).alias("h"))
    placed = slim.repartition("source", "cell").select("*", *[F.sum(valid[f].cast("long")).over(along).alias(f"n_{f}") for f in fields])
    placed = placed.join(starts, ["source", "cell"]).where((F.col("some") <= F.col("rid")) & (F.col("most") > 0))

    cells = [F.when(valid[f], F.struct(F.lit(k).alias("field"), F.col(f).alias("v"), (F.col(f"o_{f}") + F.col(f"n_{f}") - 1).alias("idx"))) for k, f in enumerate(fields)]
    series = placed.select("source", "product", "bin", "minute", "rid", "h", F.explode(F.array_compact(F.array(*cells))).alias("x"))
    own, rest = F.floor(F.col("x.idx") / block).cast("int"), F.col("x.idx") % block
    blocks = F.array_compact(F.array(own, F.when((rest < HALO) & (own > 0), own - 1), F.when(rest >= block - HALO, own + 1)))
    spread = series.select("source", "product", "bin", F.when(F.col("h").isNotNull(), F.col("minute")).alias("minute"), "rid", "h", "x.field", "x.v", "x.idx", F.explode(blocks).alias("block"))
    keys = ["source", "field", "block"]
    spread = spread.repartition(*keys)
    schema = "rid long, h long, bin int, minute int, field int"
    span = block

    def ranges(t: pa.Table) -> tuple[str, np.ndarray, np.ndarray]:
        f, code = fields[t["field"][0].as_py()], t["product"].to_numpy()
        low, high = np.full(len(code), -np.inf), np.full(len(code), np.inf)
        for k in np.unique(code):
            if k and (products[k - 1], f) in bounds:
                low[code == k], high[code == k] = (x if x is not None else s * np.inf for x, s in zip(bounds[(products[k - 1], f)], (-1, 1)))
        return f, low, high

    def in_order(t: pa.Table) -> pa.Table:
        idx = t["idx"].to_numpy()
        return t if (idx[1:] > idx[:-1]).all() else t.take(np.argsort(idx, kind="stable"))

    def medians(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = in_order(t)
        f, low, high = ranges(t)
        b, number = t["bin"].to_numpy(), t["block"][0].as_py()
        found = block_medians(t["v"].to_numpy(), np.mod(b, 24), b // 24, low, high, f in log_fields, t["idx"].to_numpy() // span == number)
        rows = [(k * 24 + h, m, n, d) for k, part in enumerate(found) for h, m, n, d in part]
        if not rows:
            return
        same = [pa.array([t[c][0].as_py()] * len(rows), kind) for c, kind in zip(keys, (pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*same, *[pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.float64(), pa.int64(), pa.int32()))]], [*keys, "slot", "mid", "n", "days"])

    def one_block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = in_order(t)
        f, low, high = ranges(t)
        b, courses = t["bin"].to_numpy(), None
        if spikes:
            told = t["course"].drop_null()
            known = told[0].as_py() if len(told) else []
            courses = [course_of([(c["slot"] - k * 24, c["mid"], c["days"]) for c in known if c["slot"] // 24 == k]) for k in range(1 + (f in log_fields))]
        hit = flag_series(t["v"].to_numpy(), np.mod(b, 24), b // 24, low, high, f in log_fields, courses=courses, spikes=spikes)
        hit &= t["idx"].to_numpy() // span == t["block"][0].as_py()
        if hit.any():
            yield from t.select(["rid", "h", "bin", "minute", "field"]).filter(pa.array(hit)).to_batches()

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions(*keys)

    if spikes:
        # medians of blocks become courses of sources; the course reaches a block at its first own reading
        slots = ordered(spread).mapInArrow(by_group(keys, medians), "source string, field int, block int, slot int, mid double, n long, days int")
        all_blocks = Window.partitionBy("source", "field", "slot")
        slots = slots.select(*keys, "slot", F.percentile("mid", F.lit(0.5), F.col("n")).over(all_blocks).alias("mid"), F.sum("days").over(all_blocks).cast("int").alias("days"))
        course = slots.groupBy(*keys).agg(F.collect_list(F.struct("slot", "mid", "days")).alias("course")).withColumn("lead", F.col("block").cast("long") * block)
        held, told = spread.alias("a"), course.alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]
        spread = held.join(told, [*same, F.col("a.idx") - F.col("b.lead") == 0], "left").select("a.*", "b.course")
    hits = ordered(spread).mapInArrow(by_group(keys, one_block), schema)
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    # the few cases that were delivered again find their other rows by content; salted, as one reading may hold many rows
    fan = 16
    salts = F.when(F.col("h").isNotNull(), F.sequence(F.lit(0), F.lit(fan - 1))).otherwise(F.array(F.lit(0)))
    again = hits.select("rid", "field", "h", F.col("bin").alias("b"), F.col("minute").alias("m"), F.explode(salts).alias("s"))
    copies = every.select("row_id", F.col("h").alias("g"), "bin", "minute", F.pmod("row_id", F.lit(fan)).cast("int").alias("salt"))
    met = again.join(copies, (again["h"] == copies["g"]) & (again["b"] == copies["bin"]) & (again["m"] == copies["minute"]) & (again["s"] == copies["salt"]), "left")
    return met.where("h is null or row_id is not null").select(F.coalesce("row_id", "rid").alias("row_id"), name.alias("field_name"))
