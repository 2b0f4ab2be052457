"""Aggregates of regions and samples, their comparison, and bounded-domain indicators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions.distributions import Cdf
from terravane.functions.stats import quantile, safe_ratio
from terravane.operators.ranking import value_counts, with_range


RANGES = 1_024


def summarize(df: DataFrame, by: list[str], score: str, flags: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """Rows, flag counts, mean and median score and further means per region in one pass."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in flags.items()], F.avg(score).alias("mean_score"), quantile(F.col(score), 0.5).alias("median_score"), *[F.avg(c).alias(n) for n, c in means.items()]
    )


def mann_whitney(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    """n1, n2, U of the first sample, rank-biserial 1-2U/(n1 n2), two-sided normal p with tie and continuity correction."""
    counted = value_counts(df, value)
    sides = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count_if(is_first).alias("a"), F.count("*").alias("c"))
    joined = counted.join(sides, "value")
    rank = F.col("below") + (F.col("same") + 1) / F.lit(2e0)
    s = joined.agg(F.sum("a").cast("double").alias("n1"), (F.sum("c") - F.sum("a")).cast("double").alias("n2"), F.sum(rank * F.col("a")).alias("r1"), F.sum(F.pow(F.col("same").cast("double"), 3) - F.col("same")).alias("ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    s = s.withColumn("u", u).withColumn("rank_biserial", 1 - 2 * F.col("u") / (F.col("n1") * F.col("n2")))
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return s.withColumn("z", F.greatest(F.lit(0.0), F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5) / sd).drop("r1", "ties")


def kolmogorov_smirnov(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    """Largest distance of the two empirical distribution functions."""
    counted = value_counts(df, value).select("value", "below", "same", "n")
    first = value_counts(df.where(is_first), value).select(F.col("value"), (F.col("below") + F.col("same")).alias("fa"), F.col("n").alias("na"))
    # at each value of the union: how many of the first sample are at most it; the missing ones carry the last count on, by ranges of the rank
    both = counted.join(first, "value", "left").withColumn("__r", F.floor(F.col("below") * RANGES / F.col("n")))
    w = Window.partitionBy("__r").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("fa", F.last("fa", ignorenulls=True).over(w))
    lasts = both.groupBy("__r").agg(F.max("fa").alias("top"))
    carried = lasts.withColumn("before", F.last("top", ignorenulls=True).over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))).select("__r", "before")
    total = first.agg(F.max("na").alias("na"))
    at = held.join(F.broadcast(carried), "__r").withColumn("na", total.scalar())  # as many rows as ranges
    a = F.coalesce("fa", "before", F.lit(0)) / F.col("na")
    b = (F.col("below") + F.col("same") - F.coalesce("fa", "before", F.lit(0))) / (F.col("n") - F.col("na"))
    return at.agg(F.max(F.abs(a - b)).alias("ks_statistic"), F.max("na").alias("n1"), F.max(F.col("n") - F.col("na")).alias("n2"))


def kolmogorov_p(d: float, n: float) -> float:
    """Asymptotic p of the Kolmogorov distance d over n effective values."""
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if t < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini coefficient per group; values are shifted to be non-negative, all zero gives 0, no values NULL.

    Equal values are counted before they are ordered, and the values of a group are ordered in ranges, so that a group with
    a third of all rows is spread over many tasks.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__x")).agg(F.count("*").alias("__c"))
    ranged = with_range(rows, F.col("__x").cast("double"))
    along = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy(*by, "__r").agg(F.sum("__c").alias("__n"), F.min("__x").alias("__m"))
    per = per.select(*by, "__r", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__before"), F.least(F.min("__m").over(Window.partitionBy(*by)), F.lit(0.0)).alias("__low"))
    joined = ranged.join(per, [*by, "__r"]) if not by else ranged.alias("a").join(per.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__r"]]).select("a.*", "b.__before", "b.__low")
    inner = Window.partitionBy(*by, "__r").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    i = F.col("__before") + F.coalesce(F.sum("__c").over(inner), F.lit(0)) + (F.col("__c") + 1) / 2.0  # mean place of equal values
    ranked = joined.select(*by, (F.col("__x") - F.col("__low")).alias("v"), i.alias("i"), "__c")
    s = ranked.groupBy(*by).agg(F.sum(F.col("v") * F.col("__c")).alias("total"), F.sum(F.col("i") * F.col("v") * F.col("__c")).alias("weighted"), F.sum("__c").cast("double").alias("n"))
    g = 2 * F.col("weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")
    return s.select(*by, F.when(F.col("total") == 0, F.lit(0.0)).otherwise(g).alias("gini"))


def rates(df: DataFrame, events: str, people: str, area: str) -> DataFrame:
    return df.withColumn("density", safe_ratio(F.col(events), F.col(area))).withColumn("per_capita", safe_ratio(F.col(events), F.col(people)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, pearson, covariance, n, p_value) for every pair of columns, from one aggregate; fewer than 3 pairs give NULL."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    aggs = df.agg(*[x for i, (a, b) in enumerate(pairs) for x in (F.corr(a, b).alias(f"r{i}"), F.count_if(both(a, b)).alias(f"n{i}"), F.covar_samp(a, b).alias(f"c{i}"))])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col(f"n{i}") >= 3, F.col(f"r{i}")).alias("pearson"), F.col(f"c{i}").alias("covariance"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
    told = aggs.select(F.inline(F.array(*cells)))

    @F.pandas_udf("double")
    def p_of(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(a, int(b)) for a, b in zip(r, n)], dtype=float)

    return told.withColumn("p_value", F.when(F.col("pearson").isNotNull(), p_of("pearson", "n")))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs, by Student's t with n - 2 degrees of freedom."""
    if n < 3 or not abs(r) < 1:
        return 0.0 if n >= 3 and abs(r) >= 1 else math.nan
    t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
    return float(min(1.0, max(0.0, 2 * (1 - Cdf("t", (float(n - 2), 0.0, 1.0))(t)[0]))))
