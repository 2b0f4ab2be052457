"""Spectral indices, band scaling and cloud masks over pixel tables (one row per pixel)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Band pairs of the indices.
INDICES = {"ndvi": ("nir", "red"), "ndmi": ("nir", "swir16"), "nbr": ("nir", "swir22"), "ndwi": ("green", "nir")}
# Scale and offset of the sensors' reflective bands, and Landsat's thermal band in Celsius.
SCALES = {"sentinel2": (1e-4, 0.0), "landsat": (2.75e-5, -0.2), "modis": (1e-4, 0.0)}
THERMAL = (0.00341802, 149.0 - 273.15)
# Sentinel-2 scene classes that are no clear ground; Landsat quality bits that mask a pixel.
SCL_BAD = (0, 1, 3, 8, 9, 10, 11)
QA_BITS = range(6)


def normalized_difference(a: Column, b: Column) -> Column:
    return F.when(F.abs(a + b) > 1e-8, (a - b) / (a + b))


def index(name: str) -> Column:
    if name == "lst":
        return F.col("thermal")
    if name not in INDICES:
        raise ValueError(f"unknown index {name}")
    a, b = INDICES[name]
    return normalized_difference(F.col(a), F.col(b))


def scale_band(sensor: str, band: str, dn: Column) -> Column:
    if sensor == "landsat" and band.startswith(("thermal", "lwir")):
        return dn * THERMAL[0] + THERMAL[1]
    k, o = SCALES[sensor]
    return dn * k + o


def clear(sensor: str, qa: Column) -> Column:
    """Whether a pixel is to be used."""
    if sensor == "sentinel2":
        return ~qa.isin(*SCL_BAD)
    if sensor == "landsat":
        mask = sum(1 << b for b in QA_BITS)
        return qa.bitwiseAND(F.lit(mask)) == 0
    return F.lit(True)


def window(pixels: DataFrame, first_row: int, first_col: int, height: int, width: int, bands: list[str], quality: str | None = None, max_pixels: int = 1_000_000) -> DataFrame:
    """(row, col, bands, quality, n) of a window, at most about ``max_pixels`` of them. pixels: (row, col, bands).

    Above that the window shrinks by sqrt(pixels / max_pixels): a target pixel has the mean of the bands of the pixels whose middles it holds,
    and the quality of the one nearest to its own middle, ties by row and column.
    """
    factor = max(1.0, math.sqrt(height * width / max(1, max_pixels)))
    rows, cols = max(1, math.ceil(height / factor)), max(1, math.ceil(width / factor))
    inside = pixels.where(F.col("row").between(first_row, first_row + height - 1) & F.col("col").between(first_col, first_col + width - 1))
    y, x = (F.col("row") - first_row + 0.5) * (rows / height), (F.col("col") - first_col + 0.5) * (cols / width)
    at = inside.select(*bands, *([quality] if quality else []), F.floor(y).cast("int").alias("__r"), F.floor(x).cast("int").alias("__c"), y.alias("__y"), x.alias("__x"), F.col("row").alias("__row"), F.col("col").alias("__col"))
    off = F.struct(F.round(F.pow(F.col("__y") - F.col("__r") - 0.5, 2) + F.pow(F.col("__x") - F.col("__c") - 0.5, 2), 9), "__row", "__col")
    told = [F.avg(b).alias(b) for b in bands] + ([F.min_by(quality, off).alias(quality)] if quality else [])
    return at.groupBy(F.col("__r").alias("row"), F.col("__c").alias("col")).agg(*told, F.count("*").alias("n"))
