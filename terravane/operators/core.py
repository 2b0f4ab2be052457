"""The compact engine: property context, linear forecast with confidence, and a population search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.geo import haversine_m

# Weights of the risk terms and their bands.
RISK = {"isolation": 0.30, "sparsity": 0.20, "change": 0.30, "volatility": 0.20}
BANDS = ((0.7, "High"), (0.4, "Medium"))


def forecast(history: DataFrame, key: str, order: str | list[str], value: str) -> DataFrame:
    """(key, next_value, slope, rmse, confidence, n) of the least-squares line over positions; one value gives itself and .25."""
    from pyspark.sql.window import Window

    s = history.where(F.col(value).isNotNull()).withColumn("__i", (F.row_number().over(Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order))) - 1).cast("double"))
    g = s.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope(value, "__i").alias("b"), F.regr_intercept(value, "__i").alias("a"), F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.regr_r2(value, "__i").alias("r2"))
    one = F.col("n") == 1
    rmse = F.when(one, 0.0).otherwise(F.sqrt(F.greatest(F.col("v") * (1 - F.coalesce("r2", F.lit(0.0))), F.lit(0.0))))
    nxt = F.when(one, F.col("m")).otherwise(F.col("a") + F.col("b") * F.col("n"))
    conf = F.when(one, 0.25).otherwise(F.least(F.greatest(1 / (1 + rmse / (F.abs("m") + 1e-12)), F.lit(0.0)), F.lit(1.0)))
    return g.select(key, nxt.alias("next_value"), F.when(one, 0.0).otherwise(F.col("b")).alias("slope"), rmse.alias("rmse"), conf.alias("confidence"), "n")


def change(history: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, relative_delta, volatility): the last value against the mean of the history, and its relative spread."""
    g = history.where(F.col(value).isNotNull()).groupBy(key).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.max_by(value, order).alias("now"))
    still = F.abs("m") < 1e-12
    return g.select(key, F.when(still, 0.0).otherwise((F.col("now") - F.col("m")) / F.abs("m")).alias("relative_delta"), F.when(still, 0.0).otherwise(F.col("s") / F.abs("m")).alias("volatility"))


def property_intelligence(nodes: DataFrame, pairs: DataFrame, history: DataFrame, key: str = "id") -> DataFrame:
    """Context of each property: near properties, density, connectivity, risk and forecast; risk and forecast are NULL without history.

    nodes: (id, lat, lon); pairs: (key_a, key_b) within the radius, as the radius join gives them; history: (id, n, value).
    """
    a, b = (nodes.select(F.col(key).alias(f"key_{s}"), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}")) for s in ("a", "b"))
    e = pairs.join(a, "key_a").join(b, "key_b").withColumn("km", haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) / 1000)
    both = e.select(F.explode(F.array("key_a", "key_b")).alias(key), "km")
    near = both.groupBy(key).agg(F.min("km").alias("nearest_km"), F.count("*").alias("nearby"), F.sum(1 / (1 + F.col("km"))).alias("w"))
    out = nodes.select(key).join(near, key, "left").fillna(0, ["nearby", "w"])
    out = out.withColumn("density", F.least(F.lit(1.0), F.col("nearby") / 12)).withColumn("connectivity", F.least(F.lit(1.0), F.col("w") / 6))
    out = out.join(change(history, key, "n", "value"), key, "left").join(forecast(history, key, "n", "value").drop("n"), key, "left")
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    risk = (1 - F.col("connectivity")) * RISK["isolation"] + (1 - F.col("density")) * RISK["sparsity"] + clip(F.abs("relative_delta")) * RISK["change"] + clip(F.col("volatility")) * RISK["volatility"]
    risk = F.when(F.col("relative_delta").isNotNull(), risk)  # greatest and least pass NULLs over
    band = F.when(risk.isNotNull(), "Low")
    for at, name in reversed(BANDS):
        band = F.when(risk >= at, name).otherwise(band)
    return out.select(key, "nearest_km", "nearby", "density", "connectivity", risk.alias("risk"), band.alias("risk_band"), "next_value", "slope", "confidence")


def grey_wolf(objective: Callable[[np.ndarray], np.ndarray], bounds: list[tuple[float, float]], population: int = 24, iterations: int = 80, seed: int = 0) -> tuple[np.ndarray, float, list[float]]:
    """Position, value and curve of a grey-wolf search (Mirjalili et al. 2014); objective takes all positions at once, so it can be one aggregate over data."""
    if population < 3:
        raise ValueError("population must be at least 3")
    g, lo, hi = np.random.default_rng(seed), *np.array(bounds, float).T
    pack = g.uniform(lo, hi, (population, len(bounds)))
    curve = []
    for t in range(iterations):
        cost = np.asarray(objective(pack), float)
        order = np.argsort(cost, kind="stable")
        leaders = pack[order[:3]]
        curve.append(float(cost[order[0]]))
        a = 2 * (1 - t / max(1, iterations - 1))
        r = g.random((2, 3, *pack.shape))
        moved = leaders[:, None, :] - (2 * a * r[0] - a) * np.abs(2 * r[1] * leaders[:, None, :] - pack[None])
        pack = np.clip(moved.mean(axis=0), lo, hi)
    cost = np.asarray(objective(pack), float)
    k = int(cost.argmin())
    return pack[k], float(cost[k]), curve
