"""Sets of keys of two tables: common, missing and checked keys. NULL keys are in no set; frequent keys are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.common import skew_join


def common(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose keys are in right."""
    return skew_join(left, right.select(*keys).distinct(), keys, "left_semi")


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose keys are not in right; rows with a NULL key are left out."""
    whole = left.dropna(subset=keys)
    return skew_join(whole, right.select(*keys).distinct(), keys, "left_anti")


def admitted(requests: DataFrame, known: DataFrame, keys: list[str], active: Column) -> DataFrame:
    """Requests with ``admitted``: whether their key exists and is active; active is a condition on ``known``."""
    live = known.where(active).select(*keys).distinct().withColumn("__live", F.lit(True))
    return skew_join(requests, live, keys, "left").withColumn("admitted", F.coalesce("__live", F.lit(False))).drop("__live")
