"""Time series per key: resampling, rolling robust deviation, change points and trend.

Rows are numbered within their series by counts per series and range of time, and windows run over blocks of BLOCK rows with
the rows before and after they need, so that a series with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions.stats import MAD_SIGMA, quantile
from terravane.operators.ranking import with_range


def hourly(df: DataFrame, ts: Column, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), quantile(F.col(value), 0.5).alias("median"))


BLOCK = 65_536


def placed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds __i, the running number from 0 of each row in its series. order begins with a number, date or time; NULL comes first."""
    kind = df.schema[order[0]].dataType.typeName()
    first = F.col(order[0])
    number = F.datediff(first, F.lit("1970-01-01")) if kind == "date" else F.unix_micros(first.cast("timestamp")) if kind.startswith("timestamp") else first
    ranged = with_range(df.withColumn("__k", number.cast("double")), F.col("__k")).drop("__k")
    along = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy(*by, "__r").agg(F.count("*").alias("__n")).select(*by, "__r", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__before"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__r"]]
    both = ranged.alias("a").join(per.alias("b"), same).select("a.*", "b.__before")
    within = Window.partitionBy(*by, "__r").orderBy(*order)
    return both.withColumn("__i", F.col("__before") + F.row_number().over(within) - 1).drop("__r", "__before")


def blocks(numbered: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """Rows of ``placed`` in their block __b and, where a neighbouring block needs them, in that one too (__own is false there)."""
    own, rest = F.floor(F.col("__i") / block), F.col("__i") % block
    near = F.array_compact(F.array(own, F.when((rest < halo) & (own > 0), own - 1), F.when(rest >= block - halo, own + 1)))
    return numbered.withColumn("__b", F.explode(near)).withColumn("__own", F.col("__b") == own)


def rolling_deviation(df: DataFrame, by: list[str], order: list[str], value: str, window: int, block: int = BLOCK) -> DataFrame:
    """Adds med, mad and the robust z of each value against a centred window of its series; where the MAD is 0 the deviation over the series' median deviation."""
    half, least = window // 2, max(5, window // 5)
    w = Window.partitionBy(*by, "__b").orderBy("__i").rowsBetween(-half, half)
    a = blocks(placed(df, by, order), 2 * half, max(block, 2 * half))
    enough = F.count(value).over(w) >= least
    a = a.withColumn("med", F.when(enough, quantile(F.col(value), 0.5).over(w)))
    a = a.withColumn("dev", F.abs(F.col(value) - F.col("med")))
    a = a.withColumn("mad", F.when(F.count("dev").over(w) >= least, quantile(F.col("dev"), 0.5).over(w)))
    a = a.where("__own").drop("__own", "__b", "__i")
    whole = a.groupBy(*by).agg(quantile(F.col("dev"), 0.5).alias("__all"))
    a = a.join(whole, by)
    z = F.coalesce(F.col("dev") / (MAD_SIGMA * F.when(F.col("mad") != 0, F.col("mad"))), F.col("dev") / (F.col("__all") + 1e-12))
    return a.withColumn("robust_z", z).drop("__all")


WIDEST, NARROWEST = 101, 11


def adaptive_deviation(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``rolling_deviation`` with a window of two fifths of the series, between NARROWEST and WIDEST readings.

    Long series all have the widest window; the windows of short ones, at most WIDEST readings, are cut to their width.
    """
    counted = df.groupBy(*by).agg(F.count(value).alias("__n"))
    known = df.join(counted, by)
    width = F.least(F.lit(WIDEST), F.greatest(F.lit(NARROWEST), F.floor(F.col("__n") / 5) * 2 + 1)).cast("int")
    known = known.withColumn("__w", width)
    long_ = rolling_deviation(known.where(F.col("__w") == WIDEST), by, order, value, WIDEST).drop("__n", "__w")
    w = Window.partitionBy(*by).orderBy(*order)
    around, half, least = w.rowsBetween(-(WIDEST // 2), WIDEST // 2), F.floor(F.col("__w") / 2), F.greatest(F.lit(5), F.floor(F.col("__w") / 5))

    def middle(s: DataFrame, column: str, out: str) -> DataFrame:
        s = s.withColumn("__near", F.collect_list(F.struct("__i", F.col(column).alias("v"))).over(around))
        s = s.withColumn("__s", F.array_sort(F.transform(F.filter("__near", lambda x: (F.abs(x["__i"] - F.col("__i")) <= half) & x["v"].isNotNull()), lambda x: x["v"])))
        n = F.size("__s")
        at = lambda i: F.try_element_at("__s", i.cast("int"))
        return s.withColumn(out, F.when(n >= least, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)).drop("__near", "__s")

    short = known.where(F.col("__w") < WIDEST).withColumn("__i", F.row_number().over(w))
    short = middle(short, value, "med").withColumn("dev", F.abs(F.col(value) - F.col("med")))
    short = middle(short, "dev", "mad")
    whole = short.groupBy(*by).agg(quantile(F.col("dev"), 0.5).alias("__all"))
    z = F.coalesce(F.col("dev") / (MAD_SIGMA * F.when(F.col("mad") != 0, F.col("mad"))), F.col("dev") / (F.col("__all") + 1e-12))
    return long_.unionByName(short.join(whole, by).withColumn("robust_z", z).drop("__all", "__i", "__n", "__w"))


def change_points(df: DataFrame, by: list[str], order: list[str], value: str, limit: float = 3.5, block: int = BLOCK) -> DataFrame:
    """Rows whose absolute first difference stands out against all differences of the series."""
    w = Window.partitionBy(*by, "__b").orderBy("__i")
    d = blocks(placed(df, by, order), 1, block).withColumn("diff", F.abs(F.col(value) - F.coalesce(F.lag(value).over(w), F.col(value))))
    d = d.where("__own").drop("__own", "__b", "__i")
    mid = d.groupBy(*by).agg(quantile(F.col("diff"), 0.5).alias("__m"))
    d = d.join(mid, by).withColumn("__o", F.abs(F.col("diff") - F.col("__m")))
    mad = d.groupBy(*by).agg((quantile(F.col("__o"), 0.5) + 1e-12).alias("__s"))
    d = d.join(mad, by).withColumn("change_score", (F.col("diff") - F.col("__m")) / (MAD_SIGMA * F.col("__s")))
    return d.where(F.col("change_score") > limit).drop("__m", "__o", "__s")


def first_changes(changes: DataFrame, by: list[str], order: list[str], most: int = 25) -> DataFrame:
    """The first ``most`` change points of each series."""
    w = Window.partitionBy(*by).orderBy(*order)
    return changes.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def trend(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Least-squares slope per step of the series, and the value the line gives next."""
    s = placed(df.where(F.col(value).isNotNull()), by, order).withColumn("__x", F.col("__i").cast("double"))
    return s.groupBy(*by).agg(F.regr_slope(value, "__x").alias("slope"), (F.regr_intercept(value, "__x") + F.regr_slope(value, "__x") * F.count("*")).alias("next_value"), F.count("*").alias("n"))
