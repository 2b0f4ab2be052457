from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators import fitting, ranking, spatialstats, temporal
from terravane.plans import analysis
from terravane.queries import anomaly
from terravane.session import cut


class Reached(Exception):
    pass


def test_variable_comparison_counts_every_row_once(spark, monkeypatch):
    seen = {}

    def spy(df, *a, **k):
        seen.update(df.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).first().asDict())
        raise Reached

    monkeypatch.setattr(analysis, "compare_variables", spy)
    with pytest.raises(Reached):
        anomaly.QUERIES["variable_comparison"](spark, "/root/testdata/sf0.001")
    assert seen["n"] == seen["ids"] > 0


def test_top_places_equal_the_ranked_deviations(spark):
    g = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, i % 3, int(g.integers(90)), float(g.normal())) for i in range(271)], "id long, s int, t int, v double")
    when = cut(temporal.adaptive_deviation(rows, ["s"], ["t", "id"], "v").select("id", "robust_z"))
    assert ranking.ordinal01(when, "robust_z", "id", "r").where("r >= 0.95").count() == analysis.top_places(271)
    for n in (1, 2, 3, 20, 21, 40, 41, 101, 60_000):
        assert analysis.top_places(n) == (np.arange(n) / max(n - 1, 1) >= 0.95).sum()


def test_positions_equal_ordinals(spark):
    values = [3.0, None, float("nan"), 1.0, 1.0, float("inf"), -2.0, 1.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values * 9)], "id long, v double").repartition(3)
    want = {r["id"]: r["o"] for r in ranking.ordinal01(rows, "v", "id", "o").collect()}
    assert {r["id"]: r["o"] for r in ranking.positions(rows, "v", "id", "o").collect()} == want
    assert ranking.positions(rows.limit(1), "v", "id", "o").first()["o"] == 0.0


def test_tails_of_values_equal_those_of_rows(spark):
    rows = spark.createDataFrame([(i, float(i % 23)) for i in range(200)], "id long, v double")
    low, params = -40.0, (9.0, 6.0)
    each = {r["v"]: r["tail_area"] for r in fitting.tail_score(rows, "v", "norm", params, low).collect()}
    told = fitting.tails_of(fitting.counted(rows, "v"), "norm", params, low).collect()
    assert sum(r["same"] for r in told) == 200 and all(abs(each[r["value"]] - r["tail_area"]) < 1e-12 for r in told)


@pytest.mark.parametrize("other", [None, "u"])
def test_held_permutations_equal_those_by_joins(spark, monkeypatch, other):
    g = np.random.default_rng(9)
    points = spark.createDataFrame([(i * 7 - 50, float(g.normal()), float(g.normal())) for i in range(60)], "id long, v double, u double")
    edges = spark.createDataFrame([(i * 7 - 50, ((i + d) % 60) * 7 - 50) for i in range(55) for d in range(1, 3 + i % 4)], "i long, j long")
    monkeypatch.setattr(spatialstats, "permuted", lambda *a: pytest.fail("permutations as rows"))
    held = {r["id"]: r["p_value"] for r in spatialstats.local_moran(points, edges, "v", 39, other).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(spatialstats, "HELD_POINTS", 0)
    assert len(held) == 55 and held == {r["id"]: r["p_value"] for r in spatialstats.local_moran(points, edges, "v", 39, other).collect()}
