"""Global ranks without a single-task window.

Values are cut into ranges at approximate quantiles (a bounded array, computed in the plan as a scalar); ranks are counted
per range and shifted by the rows of the ranges before. The result is exact: the cuts only steer the load. There are
COARSE x FINE ranges, found in two short steps, so that a range stays small on large tables. A value shared by
very many rows is counted once as a value and joined back, or, where its rows have to be told apart, cut into ranges of what
tells them apart. Average ranks of columns with many different values move every row once, to the range its value is in, and join nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType, StructField, StructType
from pyspark.sql.window import Window

from terravane.session import cut, held

COARSE, FINE = 32, 32
HOT_SHARE = 1 / 256
FEW_VALUES = 1_000_000
ALWAYS_FEW, REPEATED = 100_000, 16  # above, values are few only if each has so many rows on average
ACCURACY = 10_000
PART_ROWS = 500_000
AS_DOUBLE = (DoubleType, FloatType, IntegerType, ShortType, ByteType)  # numbers that are told apart as double


def _with_cuts(df: DataFrame, values: dict[str, Column], ranges: int) -> DataFrame:
    """Adds the cuts of each value, {name: value}. They are one row, known to be, so it goes to every task."""
    qs = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = df.agg(*[F.percentile_approx(v, qs, F.lit(4 * ranges)).alias(name) for name, v in values.items()])
    every = F.sequence(F.lit(1), F.lit(COARSE - 1))
    for name in values if ranges > COARSE else ():
        cuts = cuts.withColumn(f"{name}_", F.when(F.col(name).isNotNull(), F.transform(every, _nth(name))))
    return df.join(F.broadcast(cuts.limit(1)))


def _nth(cuts: str) -> Callable[[Column], Column]:
    return lambda i: F.element_at(cuts, (i * FINE).cast("int"))


def _under(cuts: Column | str, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < value))


def with_range(df: DataFrame, value: Column) -> DataFrame:
    """Adds __r, the number of cuts below the value, 0 where it is missing."""
    cuts = _with_cuts(df, {"__cuts": value}, COARSE * FINE).withColumn("__coarse", _under("__cuts_", value))
    fine = _under(F.slice("__cuts", F.col("__coarse") * FINE + 1, F.lit(FINE - 1)), value)
    known = F.col("__cuts").isNotNull() & value.isNotNull()
    return cuts.withColumn("__r", F.when(known, F.col("__coarse") * FINE + fine).otherwise(F.lit(0))).drop("__cuts", "__cuts_", "__coarse")


def offsets(counted: DataFrame, by: list[str], n: str) -> DataFrame:
    """Rows of the ranges before each range, and all rows; as many rows as ranges, which are bounded."""
    w = Window.orderBy(*by)
    return counted.groupBy(*by).agg(F.sum(n).alias("__rows")).select(*by, (F.sum("__rows").over(w) - F.col("__rows")).alias("__before"), F.sum("__rows").over(Window.partitionBy()).alias("__all"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, same, below, n) per distinct non-null value: rows equal to it, rows below it, all rows."""
    v = F.col(value)
    return ranked_counts(df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("value")).agg(F.count("*").alias("same")))


def ranked_counts(counted: DataFrame) -> DataFrame:
    """``value_counts`` of values that are counted already; counted: (value, same)."""
    counted = with_range(counted, F.col("value"))
    w = Window.partitionBy("__r").orderBy("value")
    inner = counted.withColumn("__in", F.sum("same").over(w) - F.col("same"))
    return inner.join(F.broadcast(offsets(counted, ["__r"], "same")), "__r").select("value", "same", (F.col("__in") + F.col("__before")).alias("below"), F.col("__all").alias("n"))


def _ranks_in_ranges(df: DataFrame, value: str, out: str, fan: int) -> DataFrame:
    """Average rank over the number of values, 0.5 where the value is missing, of a column that is exact as double; every row moves once, to its range.

    Each cut is a range of its own, from itself to the next double, so a value with more than about 1/COARSE/FINE of the rows is alone in its
    range: its rank is known from the counts of the ranges, and its rows, as the missing ones, are spread over ``fan`` parts.
    """
    v = F.when(~F.isnan(value), F.col(value).cast("double") + F.lit(0.0))  # no -0.0
    ranges = COARSE * FINE
    found = df.agg(F.percentile_approx(v, [i / ranges for i in range(1, ranges)], 4 * ranges).alias("q")).first()["q"]
    if found is None:
        return df.withColumn(out, F.lit(0.5))
    ends = np.array([-np.inf, *found], float)
    ends = np.unique(np.concatenate([ends, np.nextafter(ends, np.inf), [np.inf]]))
    last = len(ends) - 1  # the range of infinity
    alone = np.append(np.nextafter(ends[:-1], np.inf) == ends[1:], True)
    alone[last - 1] &= ends[last - 1] != np.finfo(float).max  # the last range of a Bucketizer is closed
    known = df.withColumn("__v", F.coalesce(v, F.lit(0.0)))
    placed = Bucketizer(splits=ends.tolist(), inputCol="__v", outputCol="__b").transform(known)
    place = F.when(v.isNull(), F.lit(-1)).when(F.col("__v") == float("inf"), F.lit(last)).otherwise(F.col("__b").cast("int"))
    n = np.zeros(last + 2, np.int64)  # the missing ones come last
    for row in placed.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect():  # as many as ranges
        n[row["p"]] = row["n"]
    before, total = np.cumsum(n) - n, int(n[:-1].sum())
    fixed = np.append(np.where(alone, (before[:-1] + (n[:-1] + 1) / 2e0) / total, np.nan), 0.5)  # by the range alone

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = list(batches)
        if not mine:
            return
        t = pa.Table.from_batches(mine)
        p, x = t["__p"].to_numpy() // fan, t[value].to_numpy()
        ranks = fixed[p]
        open_ = np.flatnonzero(np.isnan(ranks))
        order = open_[np.argsort(x[open_])]
        p, x = p[order], x[order]
        new = np.append(True, x[1:] != x[:-1])[: len(x)]
        first, start = np.flatnonzero(new), np.searchsorted(p, p)  # of each value; of each row's range
        same = np.diff(np.append(first, len(x)))
        ranks[order] = np.repeat((before[p[first]] + first - start[first] + (same + 1) / 2e0) / total, same)
        yield from t.drop_columns(["__p"]).append_column(out, pa.array(ranks)).to_batches()

    shared = [-1, *np.flatnonzero(alone).tolist()]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(fan)).cast("int")
    keyed = placed.withColumn("__p", place).withColumn("__p", F.col("__p") * fan + F.when(F.col("__p").isin(shared), salt).otherwise(F.lit(0)))
    parts = -(-int(n.sum()) // PART_ROWS)  # a task holds the rows of its part
    wide = [parts] if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    moved = keyed.select(*[F.col(f"`{c}`") for c in df.columns], "__p").repartition(*wide, "__p")
    return moved.mapInArrow(rank, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def percent_ranks(df: DataFrame, outs: dict[str, str], share: float = 1 / 512, fan: int = 32, few: int = FEW_VALUES, keep: bool = False) -> DataFrame:
    """Average rank over the number of non-null values, 0.5 where the value is missing, for each {value column: new column}.

    All counts come from df itself, not from each other's results. The ranks of a column with about ``few`` different values at most,
    counted first by a sketch, come to the driver, are put in order there and go to every task; above ALWAYS_FEW values only if they repeat. Of other columns the rows are ranked in ranges of their values, once
    moved there; whole numbers and decimals beyond what a double holds are counted by value and joined back. Values with more than ``share`` of the rows, at most
    1/share of them, and missing ones are spread over ``fan`` tasks; with ``keep`` a result that moved rows is read from where they are, each time.
    """
    out, sent = df, True
    many = df.agg(*[F.approx_count_distinct(value).alias(name) for value, name in outs.items()], F.count("*").alias("__rows")).first()
    sends = {name: many[name] <= min(few, max(ALWAYS_FEW, many["__rows"] // REPEATED)) for name in outs.values()}
    for value, name in sorted(outs.items(), key=lambda x: sends[x[1]]):  # what moves, moves without the ranks of few values
        v = F.when(~F.isnan(value), F.col(value))
        if sends[name]:
            told = df.where(v.isNotNull()).groupBy(v.alias("__v")).agg(F.count("*").alias("same")).toArrow().sort_by("__v")
            same = told["same"].to_numpy()
            rank = ((np.cumsum(same) - same) + (same + 1) / 2e0) / same.sum() if len(same) else np.empty(0)
            ranks = df.sparkSession.createDataFrame(pa.table({"__v": told["__v"], name: pa.array(rank, pa.float64())}))
            out = out.withColumn("__v", v).join(F.broadcast(ranks), "__v", "left").withColumn(name, F.coalesce(name, F.lit(0.5))).drop("__v")
            continue
        sent = False
        if isinstance(df.schema[value].dataType, AS_DOUBLE):
            out = _ranks_in_ranges(out, value, name, fan)
            continue
        counts = value_counts(df, value)
        rank = ((F.col("below") + (F.col("same") + 1) / F.lit(2e0)) / F.col("n")).alias(name)
        hot = F.col("same") > F.col("n") * share
        known = F.broadcast(counts.where(hot).select(F.col("value").alias("__h")))
        ranks = counts.select(F.col("value").alias("__v"), rank, F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(fan - 1))).otherwise(F.array(F.lit(0)))).alias("__s"))
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(fan)).cast("int")
        left = out.join(known, v == F.col("__h"), "left").withColumn("__v", v).withColumn("__s", F.when(F.col("__h").isNotNull() | F.col("__v").isNull(), salt).otherwise(F.lit(0)))
        out = left.join(ranks, ["__v", "__s"], "left").withColumn(name, F.coalesce(name, F.lit(0.5))).drop("__v", "__s", "__h")
    out = out.select(*[F.col(f"`{c}`") for c in (*df.columns, *outs.values())])
    return held(out) if keep and not sent else out


def quantiles(df: DataFrame, wanted: dict[str, list[float]], accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of each column, NULLs left out, as ``percentile`` gives them, but without a map of all values.

    A sketch brackets every quantile; a second aggregate counts the rows below the bracket and brings the few inside it, about
    6/accuracy of all, in which the places asked for are looked up. Should a place not be in its bracket, ``percentile`` answers.
    """
    slack = 2 / accuracy
    asked = [(c, q) for c, qs in wanted.items() for q in qs]
    ends = [F.array(*[F.lit(float(min(1.0, max(0.0, q + s)))) for q in qs for s in (-slack, slack)]) for qs in wanted.values()]
    rough = df.agg(*[F.percentile_approx(F.col(c).cast("double"), e, F.lit(accuracy)).alias(f"q{k}") for k, (c, e) in enumerate(zip(wanted, ends))], *[F.count(c).alias(f"n{k}") for k, c in enumerate(wanted)]).first()
    at = {c: k for k, c in enumerate(wanted)}
    brackets = {(c, q): rough[f"q{at[c]}"][2 * wanted[c].index(q) :][:2] for c, q in asked if rough[f"n{at[c]}"]}
    aggs = []
    for k, ((c, _), (lo, hi)) in enumerate(brackets.items()):
        v, lo, hi = F.col(c).cast("double"), F.lit(lo), F.lit(hi)
        aggs += [F.count_if(v < lo).alias(f"b{k}"), F.count_if(v == lo).alias(f"l{k}"), F.collect_list(F.when((v > lo) & (v < hi), v)).alias(f"i{k}"), F.count_if((v == hi) & (hi > lo)).alias(f"h{k}")]
    told = df.agg(*aggs).first() if aggs else None
    out: dict[tuple[str, float], float | None] = dict.fromkeys(asked)
    for k, ((c, q), (lo, hi)) in enumerate(brackets.items()):
        inner, place = np.sort(np.array(told[f"i{k}"], float)), (rough[f"n{at[c]}"] - 1) * q
        runs = [(lo, told[f"l{k}"]), *[(float(x), 1) for x in inner], (hi, told[f"h{k}"])]
        upto = told[f"b{k}"] + np.cumsum([n for _, n in runs])
        low, high = math.floor(place), math.ceil(place)
        if low < told[f"b{k}"] or high >= upto[-1]:
            out[c, q] = df.agg(F.percentile(c, F.lit(q))).first()[0]
            continue
        x, y = (runs[int(np.searchsorted(upto, i, side="right"))][0] for i in (low, high))
        out[c, q] = x if low == high or x == y else (high - place) * x + (place - low) * y
    return {c: [out[c, q] for q in qs] for c, qs in wanted.items()}


def percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    return percent_ranks(df, {value: out})


def ordinal01(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """Position in order of (value, tie), NaN and NULL last, scaled to 0..1; 0 for a single row. tie is a number.

    A value with more than HOT_SHARE of the rows, and the missing ones, stand in ranges of their own, cut along ``tie``.
    """
    v = F.when(~F.isnan(value), F.col(value))
    counted = df.groupBy(v.alias("__v")).agg(F.count("*").alias("__n"))
    total = counted.agg(F.sum("__n").alias("t")).scalar()
    hot = counted.where(F.col("__v").isNotNull() & (F.col("__n") > total * F.lit(HOT_SHARE))).agg(F.collect_list("__v").alias("__hot"))  # fewer than 1/HOT_SHARE
    ranged = with_range(df, v).join(F.broadcast(hot.limit(1)))
    ranged = _with_cuts(ranged, {"__ties": F.col(tie).cast("double")}, COARSE)
    among = lambda keep: F.size(F.filter("__hot", keep))
    # a frequent value moves on by one at itself and by one behind itself, so nothing else is in its range
    place = F.when(v.isNull(), F.lit(COARSE * FINE + 2 / HOT_SHARE).cast("int")).otherwise(F.col("__r") + among(lambda h: h < v) + among(lambda h: h <= v))
    part = F.when(v.isNull() | F.array_contains("__hot", v), _under("__ties", F.col(tie).cast("double"))).otherwise(F.lit(0))
    ranged = ranged.withColumn("__p", place).withColumn("__t", F.coalesce(part, F.lit(0))).drop("__r", "__hot", "__ties")
    keys = ["__p", "__t"]
    numbered = ranged.withColumn("__in", F.row_number().over(Window.partitionBy(*keys).orderBy(v.asc_nulls_last(), F.col(tie))))
    numbered = numbered.join(F.broadcast(offsets(ranged.withColumn("__one", F.lit(1)), keys, "__one")), keys)
    scaled = (F.col("__before") + F.col("__in") - 1) / (F.col("__all") - 1)
    return numbered.withColumn(out, F.when(F.col("__all") > 1, scaled).otherwise(F.lit(0.0))).drop(*keys, "__in", "__before", "__all")


def positions(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """(tie, out) with out as ``ordinal01`` gives it, for narrow rows: they are sorted over ranges of (value, tie), cut, and numbered by the rows of the ranges before."""
    v = F.when(~F.isnan(value), F.col(value))
    placed = cut(df.select(tie, v.alias("__v")).orderBy(F.col("__v").asc_nulls_last(), tie).select(tie)).select(tie, F.monotonically_increasing_id().alias("__at"))
    part, size = F.shiftrightunsigned("__at", 33).cast("int"), 1 << 33
    found = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # as many as partitions
    n, before, shifts = sum(found.values()), 0, []
    for p in range(max(found, default=-1) + 1):
        shifts.append(float(before - p * size))
        before += found.get(p, 0)
    if n <= 1:
        return placed.select(tie, F.lit(0.0).alias(out))
    shift = F.element_at(F.array(*[F.lit(s) for s in shifts]), part + 1)
    return placed.select(tie, ((F.col("__at") + shift) / F.lit(float(n - 1))).alias(out))


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """Adds the running number from 0 in order of the number ``by``."""
    ranged = with_range(df, F.col(by).cast("double"))
    inner = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__r").orderBy(by)))
    before = F.broadcast(offsets(ranged.withColumn("__one", F.lit(1)), ["__r"], "__one"))
    return inner.join(before, "__r").withColumn(out, F.col("__before") + F.col("__in") - 1).drop("__r", "__in", "__before", "__all")
