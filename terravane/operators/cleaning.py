"""Ingest-time cleaning, quality and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from terravane.functions.stats import finite, quantile


def union_sources(parts: list[DataFrame], names: list[str], lineage: str = "_source_file") -> DataFrame:
    """All rows under the union of the columns, each with the name of its source."""
    tagged = [p.withColumn(lineage, F.lit(n)) for p, n in zip(parts, names)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every key in ``order``; keys that are missing from df are ignored. Reduces map-side, so a hot key is one row per partition."""
    present = [k for k in keys if k in df.columns]
    if not present:
        return df
    rest = [c for c in df.columns if c not in present]
    kept = df.groupBy(*present).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row"))
    return kept.select(*[F.col(c) if c in present else F.col(f"__row.{c}").alias(c) for c in df.columns])


def without_infinities(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing and unreadable numbers become the column's exact median."""
    read = df.withColumns({c: finite(F.col(c).try_cast("double")) for c in columns})
    middles = read.agg(*[quantile(F.col(c), 0.5).alias(c) for c in columns])
    return read.withColumns({c: F.coalesce(F.col(c), middles.select(c).scalar()) for c in columns})


def robust_scale(df: DataFrame, columns: list[str], suffix: str = "_scaled") -> DataFrame:
    """(x - median) / (p75 - p25), with 1 for a zero range; one aggregate for all columns."""
    aggs = df.agg(*[quantile(F.col(c), [0.25, 0.5, 0.75]).alias(f"__q_{c}") for c in columns])
    out = df
    for c in columns:
        q = aggs.select(f"__q_{c}").scalar()
        width = q[2] - q[0]
        out = out.withColumn(c + suffix, (F.col(c) - q[1]) / F.when(width == 0, F.lit(1.0)).otherwise(width))
    return out


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return lon.between(west, east) & lat.between(south, north)


def in_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Boundary-inclusive ray casting as one expression; the box comes first and reaches the scan."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    inside, edge = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        cross = F.lit(bx - ax) * (lat - ay) - F.lit(by - ay) * (lon - ax)
        edge = edge | ((cross == 0) & lon.between(min(ax, bx), max(ax, bx)) & lat.between(min(ay, by), max(ay, by)))
        if ay != by:
            inside = inside != (((F.lit(ay) > lat) != (F.lit(by) > lat)) & ((cross > 0) == F.lit(by > ay)))
    return in_box(lon, lat, (min(xs), min(ys), max(xs), max(ys))) & (inside | edge)


def profile(df: DataFrame, usable: int = 30) -> DataFrame:
    """One row per column: kind, filled rows, missing ratio, distinct values, numeric ratio, usable as a measure. One aggregate over all columns."""
    aggs, cells = [], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        number = isinstance(f.dataType, NumericType)
        missing = c.isNull() | (F.isnan(c) if number and f.dataType.typeName() in ("double", "float") else F.lit(False))
        plain = c.cast("string") if f.dataType.typeName() in ("array", "map", "struct") else c
        as_number = F.lit(None).cast("double") if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)) or f.dataType.typeName() in ("array", "map", "struct", "binary", "boolean") else finite(c.try_cast("double"))
        aggs += [F.count("*").alias(f"n{i}"), F.count(F.when(~missing, 1)).alias(f"f{i}"), F.count_distinct(F.when(~missing, plain)).alias(f"d{i}"), F.count(as_number).alias(f"m{i}")]
        filled = F.col(f"f{i}")
        cells.append(F.struct(F.lit(f.name).alias("column"), filled.alias("non_null"), (1 - filled / F.nullif(F.col(f"n{i}"), F.lit(0))).alias("missing_ratio"), F.col(f"d{i}").alias("distinct_values"), (F.col(f"m{i}") / F.nullif(filled, F.lit(0))).alias("numeric_ratio"), (F.col(f"m{i}") >= usable).alias("usable_numeric")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def quality(df: DataFrame, lon: str, lat: str, invalid: Column | None = None, min_score: float = 0.70) -> DataFrame:
    """Quality of a point table in one aggregate: missing, invalid, repeated and out-of-range positions, columns mostly empty, score, grade and gate."""
    x, y = F.col(lon), F.col(lat)
    missing = x.isNull() | y.isNull()
    away = ~missing & ~(x.between(-180.0, 180.0) & y.between(-90.0, 90.0))
    sparse = [F.when(F.avg(F.col(f"`{c}`").isNull().cast("double")) > 0.5, 1).otherwise(0) for c in df.columns]
    m = df.agg(
        F.count("*").alias("rows"), F.count_if(missing).alias("missing_positions"), F.count_if(invalid if invalid is not None else F.lit(False)).alias("invalid_positions"),
        (F.count(F.when(~missing, 1)) - F.count_distinct(F.when(~missing, F.struct(x, y)))).alias("repeated_positions"), F.count_if(away).alias("out_of_range"),
        reduce(lambda a, b: a + b, sparse).cast("long").alias("sparse_columns"),
    )
    part = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("rows"), F.lit(0)), F.lit(0.0))
    penalty = part("missing_positions") * 0.25 + part("invalid_positions") * 0.25 + part("repeated_positions") * 0.15 + part("out_of_range") * 0.25 + F.col("sparse_columns") / len(df.columns) * 0.10
    grade = F.when(F.col("score") >= 0.95, "excellent").when(F.col("score") >= 0.85, "good").when(F.col("score") >= 0.70, "warning").otherwise("poor")
    gate = F.when(F.col("out_of_range") > 0, "blocked").when(F.col("score") < min_score, "warning").otherwise("passed")
    return m.withColumn("score", F.greatest(F.lit(0.0), 1 - penalty)).withColumn("grade", grade).withColumn("gate", gate)
