"""Remote sources as Python data sources; the HTTP call is injected, so they run on recorded answers without a network."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Products the fire archive serves, and the columns renamed to their common names.
FIRE_PRODUCTS = ("LANDSAT_NRT", "MODIS_NRT", "MODIS_SP", "VIIRS_NOAA20_NRT", "VIIRS_NOAA20_SP", "VIIRS_NOAA21_NRT", "VIIRS_SNPP_NRT", "VIIRS_SNPP_SP")
RENAMED = {"BRIGHT_TI4": "BRIGHTNESS", "BRIGHT_TI5": "BRIGHT_T31"}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable[[dict[str, str]], str]) -> None:
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(d) for d in range(int(self.options.get("days", "1")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield (partition.value, self.fetch(self.options | {"day": str(partition.value)}))


def text_source(name: str, fetch: Callable[[dict[str, str]], str]) -> type[DataSource]:
    """A data source ``name`` with one partition per day asked for; fetch(options) gives the body of an answer."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "part int, body string"

        def reader(self, schema):  # noqa: ANN001, ANN201
            return _Reader(dict(self.options), fetch)

    return Source


def check_fire_request(product: str, box: tuple[float, float, float, float], days: int) -> None:
    west, south, east, north = box
    if product not in FIRE_PRODUCTS:
        raise ValueError(f"unknown product {product}")
    if not 1 <= days <= 5:
        raise ValueError("days must be 1 to 5")
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError("bad bounding box")


def fires(spark: SparkSession, fetch: Callable[[dict[str, str]], str], product: str, box: tuple[float, float, float, float], days: int = 1) -> DataFrame:
    """Detections of an area: upper-case columns, common brightness names, lon and lat as numbers. Bodies are CSV."""
    check_fire_request(product, box, days)
    spark.dataSource.register(text_source("terravane_fires", fetch))
    body = spark.read.format("terravane_fires").options(product=product, box=",".join(map(str, box)), days=str(days)).load()

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"r": [{RENAMED.get(k.upper(), k.upper()): v for k, v in r.items()} for text in b["body"] for r in csv.DictReader(io.StringIO(text or ""))]})

    rows = body.select("body").mapInPandas(records, "r map<string,string>")
    num = lambda k: F.col("r")[k].try_cast("double").alias(k)
    return rows.select(F.col("r")["LATITUDE"].try_cast("double").alias("lat"), F.col("r")["LONGITUDE"].try_cast("double").alias("lon"), *[num(k) for k in ("BRIGHTNESS", "BRIGHT_T31", "FRP", "SCAN", "TRACK")], *[F.col("r")[k].alias(k) for k in ("ACQ_DATE", "ACQ_TIME", "SATELLITE", "CONFIDENCE")], F.lit(product).alias("_api_source"))


def weather(spark: SparkSession, fetch: Callable[[dict[str, str]], str]) -> DataFrame:
    """Hourly series of an answer with parallel arrays."""
    spark.dataSource.register(text_source("terravane_weather", fetch))
    body = spark.read.format("terravane_weather").load()
    shape = "struct<hourly:struct<time:array<string>,temperature_2m:array<double>,relative_humidity_2m:array<double>,precipitation:array<double>,wind_speed_10m:array<double>>>"
    h = F.from_json("body", shape)["hourly"]
    rows = body.select(F.explode(F.arrays_zip(*[h[c].alias(c) for c in ("time", "temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m")])).alias("z"))
    names = ("time", "temperature", "humidity", "precipitation", "wind")
    return rows.select(F.col("z.time").try_cast("timestamp").alias(names[0]), F.col("z.temperature_2m").alias(names[1]), F.col("z.relative_humidity_2m").alias(names[2]), F.col("z.precipitation").alias(names[3]), F.col("z.wind_speed_10m").alias(names[4]))


def daily_weather(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy(F.to_date("time").alias("day")).agg(F.avg("temperature").alias("temperature"), F.avg("humidity").alias("humidity"), F.sum("precipitation").alias("precipitation"), F.avg("wind").alias("wind"))


def box_of(geometry: str) -> list[float]:
    """west, south, east, north of GeoJSON text."""
    flat: list[tuple[float, float]] = []

    def walk(c) -> None:  # noqa: ANN001
        if c and isinstance(c[0], (int, float)):
            flat.append((float(c[0]), float(c[1])))
        else:
            for x in c:
                walk(x)

    walk(json.loads(geometry)["coordinates"])
    xs, ys = zip(*flat)
    return [min(xs), min(ys), max(xs), max(ys)]


def scenes(items: DataFrame, max_cloud: float, needs: dict[str, list[str]], limit: int = 100) -> DataFrame:
    """(id, time, cloud, derivable) of the at most ``limit`` (1 to 100) clearest catalog items below a cloud cover; ``items`` has a JSON ``item``; needs: index -> asset keys."""
    j = F.from_json("item", "struct<id:string,properties:map<string,string>,assets:map<string,string>>")
    rows = items.select(j.alias("j")).select("j.id", F.col("j.properties")["datetime"].try_cast("timestamp").alias("time"), F.col("j.properties")["eo:cloud_cover"].try_cast("double").alias("cloud"), F.map_keys("j.assets").alias("keys"))

    def has(keys: list[str]) -> Column:
        return F.size(F.array_intersect("keys", F.array(*[F.lit(k) for k in keys]))) == len(keys)

    derivable = F.array_compact(F.array(*[F.when(has(k), n) for n, k in needs.items()]))
    return rows.where(F.coalesce(F.col("cloud"), F.lit(0.0)) <= max_cloud).select("id", "time", "cloud", derivable.alias("derivable")).orderBy("cloud", "id").limit(min(max(limit, 1), 100))


def registry(spark: SparkSession, keys: dict[str, str | None]) -> DataFrame:
    """(name, kind, needs_key, configured) of the remote sources; ``keys`` holds the keys there are, none of which is shown."""
    known = [("fires", "points", True), ("weather", "series", False), ("scenes", "catalog", False)]
    return spark.createDataFrame([(n, k, need, not need or bool((keys.get(n) or "").strip())) for n, k, need in known], "name string, kind string, needs_key boolean, configured boolean")
