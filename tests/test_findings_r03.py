from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators import factor, featurespace, neighbours, packed, ranking
from terravane.plans import analysis
from terravane.session import cut


def items(spark, n=900, seed=4):
    """Rows at few positions, some of them with few rows, with missing values and positions."""
    g = np.random.default_rng(seed)
    at = np.where(g.random(n) < 0.8, g.integers(0, 20, n), g.integers(20, 90, n))
    places = np.round(g.normal(size=(90, 2)) * 50, 1)
    rows = [(int(i * 7 % n), None if i % 97 == 0 else float(places[a, 0]), float(places[a, 1]), float(g.integers(0, 9)), float(g.normal()), None if i % 11 == 0 else float(g.normal()), i % 3, i) for i, a in enumerate(at)]
    return spark.createDataFrame(rows, "id long, x double, y double, a double, b double, c double, s int, t int").repartition(3)


def by_edges(rows, variable):
    here = rows.where(F.col("x").isNotNull() & F.col(variable).isNotNull()).select("id", "x", "y", F.col(variable).alias("v"))
    m = here.agg(F.avg("v"), F.stddev_samp("v") + 1e-12).first()
    return analysis._among_by_edges(here, 12, *m)


@pytest.mark.parametrize("tile", [800_000, 60])
def test_variables_are_compared_without_a_list_of_edges(spark, monkeypatch, tile):
    rows = items(spark)
    want = [by_edges(rows, c) for c in "abc"]
    monkeypatch.setattr(packed, "TILE_ROWS", tile)
    monkeypatch.setattr(packed, "PER_TILE", 20)
    monkeypatch.setattr(packed, "GROUP", 16)
    monkeypatch.setattr(analysis, "_among_by_edges", lambda *a: pytest.fail("a list of all edges"))
    monkeypatch.setattr(neighbours, "lof_with_value", lambda *a: pytest.fail("a list of all edges"))
    got = analysis.compare_variables(rows, ["a", "b", "c"], "s", ["t"], candidates=["norm", "uniform"]).collect()
    assert [r["spatial_anomalies_95"] for r in got] == want and sum(want) > 0
    assert [r["n"] for r in got] == [900, 900, 818] and [r["temporal_anomalies_95"] for r in got] == [45, 45, analysis.top_places(818)]


@pytest.mark.parametrize("tile", [800_000, 100])
def test_factors_by_tiles_equal_those_of_all_rows(spark, monkeypatch, tile):
    rows = items(spark)
    want = {r["id"]: r["lof"] for r in neighbours.lof_with_value(rows.where("x is not null and c is not null").select("id", "x", "y", F.col("c").alias("v")), "v", 13).collect()}
    monkeypatch.setattr(packed, "TILE_ROWS", tile)
    monkeypatch.setattr(packed, "PER_TILE", 20)
    monkeypatch.setattr(packed, "GROUP", 16)
    blobs = packed.pack(rows.withColumn("f", F.lit(True)), ["a", "b", "c"], ["f"])
    q = packed.quantiles(blobs, ["x", "y", "v2"], [0.25, 0.5, 0.75])
    known = packed.unpack(blobs, {"x": "x", "y": "y", "v2": "v2"}).dropna()
    want_q = ranking.quantiles(known, {c: [0.25, 0.5, 0.75] for c in q})
    assert all(q[c] == pytest.approx(want_q[c]) for c in q)
    found = packed.local_factors(blobs, "v2", 13, len(want), [(q[c][1], q[c][2] - q[c][0]) for c in q])
    got = {}
    for r in found.collect():
        t = packed._read(r["data"])
        got |= dict(zip(t["id"].tolist(), t["lof"].tolist()))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_parts_too_large_for_a_task_go_by_edges(spark, monkeypatch):
    rows = items(spark, 300)
    want = [by_edges(rows, c) for c in "bc"]
    monkeypatch.setattr(packed, "HELD_ROWS", 10)
    assert [r["spatial_anomalies_95"] for r in analysis.compare_variables(rows, ["b", "c"], "s", ["t"], candidates=["norm"]).collect()] == want


@pytest.mark.parametrize("n, digits", [(5, 2), (40, 1), (900, 1), (900, 0), (3_000, 2)])
def test_neighbourhoods_equal_the_nearest(n, digits):
    g = np.random.default_rng(n)
    x = np.unique(np.round(g.normal(size=(n, 3)), digits), axis=0)
    w = g.integers(1, 4, len(x))
    near, used, _ = factor.neighbourhoods(x, w, 13)
    for q, j, u, _ in featurespace.nearest(x, w, np.arange(len(x)), 13):
        for a, i in enumerate(q):
            assert {*zip(j[a][u[a] > 0], u[a][u[a] > 0])} == {*zip(near[i][used[i] > 0], used[i][used[i] > 0])}


def test_places_count_pairs():
    g = np.random.default_rng(2)
    for values in (3, 500):
        ends = sorted({(float(a), int(b)) for a, b in zip(g.integers(0, values, 400), g.integers(0, 99, 400))})
        v, i = g.integers(-1, values + 1, 700).astype(float), g.integers(-1, 100, 700)
        got = packed.places(v, i, np.array([e[0] for e in ends]), np.array([e[1] for e in ends]))
        assert got.tolist() == [sum(e <= (a, b) for e in ends) for a, b in zip(v.tolist(), i.tolist())]
    none = packed.places(v, i, np.empty(0), np.empty(0, int))
    assert not none.any()


def test_neighbours_of_those_that_ask(spark):
    rows = cut(items(spark).where("x is not null").select("id", "x", "y", (F.col("id") % 7 == 0).alias("asks")))
    some = neighbours.knn(rows, 4, 50, "asks")
    assert sorted(some.collect()) == sorted(r for r in neighbours.knn(rows, 4, 50).collect() if r["i"] % 7 == 0)
