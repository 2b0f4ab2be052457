"""Column forms of the descriptive statistics the engine uses throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MAD to standard deviation of a normal distribution.
MAD_SIGMA = 1.4826


def quantile(c: Column | str, q: float | list[float]) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(c, F.lit(q) if isinstance(q, float) else F.array(*[F.lit(x) for x in q]))


def finite(c: Column) -> Column:
    """The value, NULL where it is NULL, NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def safe_ratio(a: Column, b: Column) -> Column:
    """a/b, NULL where b is 0 or NULL."""
    return a / F.when(b != 0, b)


def euclid(parts: list[Column]) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + p * p
    return F.sqrt(total)
