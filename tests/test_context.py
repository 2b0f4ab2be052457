from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terravane.functions import raster
from terravane.operators import detect, keys
from terravane.plans import enrichment
from terravane.sources import remote


def test_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (None, "z")], "k long, v string")
    b = spark.createDataFrame([(2, True), (3, True), (None, True), (1, False)], "k long, live boolean")
    assert sorted(r["v"] for r in keys.common(a, b, ["k"]).collect()) == ["x", "y", "y"]
    assert [r["v"] for r in keys.missing(a, b.where("k <> 1"), ["k"]).collect()] == ["x"]
    told = {(r["v"], r["admitted"]) for r in keys.admitted(a, b, ["k"], F.col("live")).collect()}
    assert told == {("x", False), ("y", True), ("z", False)}
    assert keys.common(a.limit(0), b, ["k"]).count() == keys.common(a, b.limit(0), ["k"]).count() == 0


def test_enrichment(spark):
    rows = [(i, -75.0 + i / 100, 6.0, f"2024-01-{i + 1:02d}") for i in range(12)] + [(99, None, 6.0, None), (98, 500.0, 1.0, "2020-01-01")]
    df = spark.createDataFrame(rows, "id long, lon double, lat double, day string")
    planned = enrichment.plan(df, "day", weather=True, fires=True, fire_key=False)
    p = planned.first()
    assert p["weather"] and not p["fires"] and p["west"] == -75.0 and str(p["last_day"]) == "2024-01-12" and p["warnings"] == ["the fire service has no key"]
    asked = []

    def weather(lat, lon, day):
        asked.append((lat, lon, day))
        return {"rain": 2.0, "note": "x"}

    out = {r["provider"]: r for r in enrichment.execute(df, planned, "day", weather, lambda box, day: []).collect()}
    assert len(asked) == enrichment.SAMPLE and out["weather"]["mean"] == 2.0 and out["fires"]["status"] == "skipped"

    def broken(*_):
        raise OSError("no line")

    failed = enrichment.execute(df, enrichment.plan(df, "day", True, True, True), "day", broken, broken).collect()
    assert {(r["provider"], r["status"], r["reason"]) for r in failed} == {("weather", "error", "no line"), ("fires", "error", "no line")}
    bare = enrichment.plan(df.limit(0), None, True, True, True).first()
    assert not bare["weather"] and bare["warnings"] == ["no valid position"]
    assert not enrichment.plan(df.withColumn("FRP", F.lit(1.0)).withColumn("Rainfall", F.lit(1)), "day", True, True, True).first()["weather"]


def test_transfer_and_registry(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 10.0, 0.0, 7.0), (3, 1.0, 0.0, None), (4, 5.0, 0.0, None), (5, None, 0.0, None)], "id long, x double, y double, s double")
    got = {r["id"]: (r["s"], r["source"]) for r in detect.transfer(rows, rows.where("s is not null"), ["x", "y"], "s").collect()}
    assert got == {1: (5.0, 1), 2: (7.0, 2), 3: (5.0, 1), 4: (5.0, 1), 5: (None, None)}
    none = detect.transfer(rows, rows.limit(0), ["x", "y"], "s").collect()
    assert all(r["s"] is None for r in none)
    with pytest.raises(ValueError):
        detect.transfer(rows, rows, ["x", "y"], "s", most=2)
    told = {r["name"]: r["configured"] for r in remote.registry(spark, {"fires": " "}).collect()}
    assert told == {"fires": False, "weather": True, "scenes": True}


def test_window_shrinks(spark):
    px = spark.createDataFrame([(y, x, float(10 * y + x), y) for y in range(6) for x in range(8)], "row int, col int, red double, qa int")
    whole = raster.window(px, 1, 2, 4, 4, ["red"], "qa")
    assert whole.count() == 16 and whole.where("row = 0 and col = 0").first()["red"] == 12.0
    small = {(r["row"], r["col"]): (r["red"], r["n"]) for r in raster.window(px, 1, 2, 4, 4, ["red"], "qa", max_pixels=4).collect()}
    assert small == {(0, 0): (17.5, 4), (0, 1): (19.5, 4), (1, 0): (37.5, 4), (1, 1): (39.5, 4)}
