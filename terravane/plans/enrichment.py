"""What outside context would help a table, and its fetching; context never changes a score.

A plan is one aggregate over the table. Fetching asks each recommended provider for a bounded sample of positions and
records what came of it; a provider that fails is an entry in the result, not an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that make asking for weather or fires needless.
WEATHER_COLUMNS = ("precipitation", "rainfall", "temperature", "surface_temperature", "humidity", "relative_humidity")
FIRE_COLUMNS = ("frp", "brightness", "bright_ti4", "bright_ti5")
SAMPLE = 8


def plan(df: DataFrame, date: str | None, weather: bool, fires: bool, fire_key: bool) -> DataFrame:
    """One row (west, south, east, north, mid_lon, mid_lat, first_day, last_day, weather, fires, warnings).

    df: (lon, lat, ..); weather and fires say whether they matter to the domain, fire_key whether the fire service can be asked.
    The flags are true where the columns are missing from df; the middle is that of the distinct positions.
    """
    have = {c.lower() for c in df.columns}
    day = F.col(date).cast("date") if date else F.lit(None).cast("date")
    placed = df.where(F.col("lon").between(-180.0, 180.0) & F.col("lat").between(-90.0, 90.0)).groupBy("lon", "lat").agg(F.min(day).alias("a"), F.max(day).alias("b"))
    told = placed.agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.avg("lon").alias("mid_lon"), F.avg("lat").alias("mid_lat"),
        F.min("a").alias("first_day"), F.max("b").alias("last_day"), F.count("*").alias("n"),
    )
    some = F.col("n") > 0
    warnings = F.array_compact(F.array(F.when(~some, F.lit("no valid position")), F.when(some & F.lit(fires and not fire_key), F.lit("the fire service has no key"))))
    return told.select(
        *[c for c in told.columns if c != "n"], (some & F.lit(weather and not have & set(WEATHER_COLUMNS))).alias("weather"), (some & F.lit(fires and fire_key and not have & set(FIRE_COLUMNS))).alias("fires"), warnings.alias("warnings"),
    )


def sampled(df: DataFrame, date: str, key: str = "id", most: int = SAMPLE) -> DataFrame:
    """The at most ``most`` dated rows to ask about, the same on every run: those with the smallest hash of their id."""
    whole = df.where(F.col(date).cast("date").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return whole.select(key, "lon", "lat", F.col(date).cast("date").alias("day")).orderBy(F.xxhash64(key), key).limit(most)


def execute(df: DataFrame, planned: DataFrame, date: str, fetch_weather: Callable[[float, float, str], dict[str, float]], fetch_fires: Callable[[list[float], str], list[dict]]) -> DataFrame:
    """(provider, status ok|skipped|error, reason, name, mean, low, high, n): summaries of what the providers give."""
    p = planned.first()
    rows: list[tuple] = []

    def summed(provider: str, got: list[dict]) -> None:
        names = sorted({k for g in got for k, v in g.items() if isinstance(v, (int, float))})
        for name in names:
            v = [float(g[name]) for g in got if isinstance(g.get(name), (int, float))]
            rows.append((provider, "ok", None, name, sum(v) / len(v), min(v), max(v), len(v)))
        if not names:
            rows.append((provider, "ok", None, None, None, None, None, len(got)))

    for provider, wanted, ask in (
        ("weather", p["weather"], lambda: [fetch_weather(r["lat"], r["lon"], str(r["day"])) for r in sampled(df, date).collect()]),
        ("fires", p["fires"], lambda: fetch_fires([p["west"], p["south"], p["east"], p["north"]], str(p["last_day"]))),
    ):
        if not wanted:
            rows.append((provider, "skipped", "not recommended", *[None] * 5))
            continue
        try:
            summed(provider, ask())
        except Exception as failed:  # noqa: BLE001
            rows.append((provider, "error", str(failed), *[None] * 5))
    return df.sparkSession.createDataFrame(rows, "provider string, status string, reason string, name string, mean double, low double, high double, n long")
