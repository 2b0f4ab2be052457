"""Sinks: the scored layer as Parquet by level, CSV with WKT, histogram and priority sample for display, reports."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.stats import quantile


def wkt(lon: Column, lat: Column) -> Column:
    return F.format_string("POINT (%s %s)", lon.cast("string"), lat.cast("string"))


def write_layer(scored: DataFrame, path: str, level: str = "outlier_level") -> None:
    """Parquet partitioned by level, so a reader of one level reads only that."""
    scored.write.mode("overwrite").partitionBy(level).parquet(path)


def write_csv(scored: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    scored.withColumn("geometry_wkt", wkt(F.col(lon), F.col(lat))).write.mode("overwrite").option("header", True).csv(path)


def top_rows(scored: DataFrame, score: str, limit: int = 300) -> DataFrame:
    return scored.orderBy(F.desc(score)).limit(limit)


def map_points(scored: DataFrame, flagged: str, row_id: str, limit: int = 5_000) -> DataFrame:
    """Points for a map: all flagged rows first, then the smallest hashes, at most ``limit``."""
    return scored.orderBy(F.col(flagged).desc(), F.md5(F.col(row_id).cast("string"))).limit(limit)


def display_histogram(df: DataFrame, value: str, most: int = 200) -> DataFrame:
    """(bin, low, n) with Freedman-Diaconis width."""
    v = df.where(F.col(value).isNotNull())
    s = v.agg(quantile(F.col(value), [0.25, 0.75]).alias("q"), F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
    q, n, a, b = (s.select(c).scalar() for c in ("q", "n", "a", "b"))
    width = F.greatest(2 * (q[1] - q[0]) / F.cbrt(n), (b - a) / most, F.lit(1e-12))
    return v.groupBy(F.floor((F.col(value) - a) / width).alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("low"))


def markdown(summary: dict) -> str:
    lines = ["# Analysis report", ""]
    for k, v in summary.items():
        lines += [f"- **{k}**: {v}"] if not isinstance(v, dict) else [f"## {k}", *[f"- {a}: {b}" for a, b in v.items()]]
    return "\n".join(lines) + "\n"


def html_report(title: str, summary: dict) -> str:
    rows = "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(str(v))}</td></tr>" for k, v in summary.items())
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{rows}</table>"
