from __future__ import annotations

import numpy as np
import pytest

from terravane.functions.geo import haversine_np
from terravane.operators import graph, neighbours, radius

R_M = 2_000.0


@pytest.fixture(scope="module")
def field(spark):
    """Points on a grid with gaps and repeats, across the date line and at a pole, some alone, some without a position; and all edges."""
    g = np.random.default_rng(4)
    lat = np.concatenate([g.integers(0, 60, 500) / 400, g.integers(0, 30, 150) / 300 + 40, 90 - g.uniform(0, 0.05, 60), [-30.0, 7.0]])
    lon = np.concatenate([g.integers(0, 60, 500) / 400 + 10, g.integers(-15, 15, 150) / 300 % 360 + 180, g.uniform(-180, 180, 60), [5.0, 7.0]])
    lon = np.where(lon > 180, lon - 360, lon)
    ids = g.permutation(len(lat))
    rows = [(int(i), float(a), float(b)) for i, a, b in zip(ids, lat, lon)]
    points = spark.createDataFrame([*rows, (5_000, None, 1.0)], "id long, lat double, lon double")
    rows.sort()
    i, j = np.triu_indices(len(rows), 1)
    at = np.array([r[1:] for r in rows])
    w = haversine_np(at[i, 0], at[i, 1], at[j, 0], at[j, 1])
    edges = [(rows[a][0], rows[b][0], float(d)) for a, b, d in zip(i[w <= R_M], j[w <= R_M], w[w <= R_M])]
    return points, spark.createDataFrame(edges, "src long, dst long, weight double").cache()


def plain(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("rows", [40, 10_000])
def test_components_without_a_list_of_edges(field, rows):
    points, edges = field
    got = radius.components_within(points, R_M, radius.forest(points, R_M, rows))
    assert plain(got) == plain(graph.components(points, edges))


@pytest.mark.parametrize("rows,most", [(40, 0), (40, 1_000), (10_000, 1_000)])
def test_spanning_tree_without_a_list_of_edges(field, rows, most):
    points, edges = field
    got = radius.spanning_tree_within(points, R_M, radius.forest(points, R_M, rows), most)
    assert plain(got) == plain(graph.spanning_tree(points, edges))


@pytest.mark.parametrize("rows", [40, 10_000])
def test_paths_without_a_list_of_edges(spark, rows):
    g = np.random.default_rng(8)
    at = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(g.integers(0, 40, 150) / 600 + 60, g.integers(0, 40, 150) / 300 + 179.95))]
    at = [(i, a, b - 360 if b > 180 else b) for i, a, b in at]
    points = spark.createDataFrame([*at, (900, None, 1.0)], "id long, lat double, lon double")
    i, j = np.triu_indices(len(at), 1)
    xy = np.array([r[1:] for r in at])
    w = haversine_np(xy[i, 0], xy[i, 1], xy[j, 0], xy[j, 1])
    want = np.full((len(at), len(at)), np.inf)
    want[i, j] = want[j, i] = np.where(w <= R_M, w, np.inf)
    np.fill_diagonal(want, 0)
    for k in range(len(at)):
        want = np.minimum(want, want[:, k : k + 1] + want[k : k + 1])
    got = {r["id"]: r["distance"] for r in radius.shortest_paths_within(points, 3, R_M, rows).collect()}
    assert set(got) == set(np.flatnonzero(np.isfinite(want[3])).tolist()) and len(got) > 20
    assert all(abs(want[3][k] - v) < 1e-6 for k, v in got.items())
    assert [tuple(r) for r in radius.shortest_paths_within(points, 900, R_M).collect()] == [(900, 0.0)]


def test_corridors_without_a_list_of_edges(spark):
    g = np.random.default_rng(6)
    at = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(g.integers(0, 60, 120) / 250 + 6, g.integers(0, 60, 120) / 250 - 75))]
    points = spark.createDataFrame(at, "id long, lat double, lon double")
    i, j = np.triu_indices(len(at), 1)
    xy = np.array([r[1:] for r in at])
    w = haversine_np(xy[i, 0], xy[i, 1], xy[j, 0], xy[j, 1])
    edges = spark.createDataFrame([(int(a), int(b), float(d)) for a, b, d in zip(i[w <= R_M], j[w <= R_M], w[w <= R_M])], "src long, dst long, weight double")
    density = points.select("id", (points["lat"] - 6).alias("density"))
    got = plain(radius.corridors_within(points, R_M, density, rows=30))
    assert got == plain(graph.corridors(points, edges, density)) and len(got) > 1


def test_density_of_full_and_other_squares(spark):
    g = np.random.default_rng(2)
    xy = np.concatenate([g.normal(0.6, 0.5, (2_400, 2)), g.uniform(-6, 6, (99, 2))])  # more than NODES x NODES in the square of 0..1.2
    v = np.arange(len(xy)) % 3
    df = spark.createDataFrame([*[(i, float(x), float(y), float(u)) for i, ((x, y), u) in enumerate(zip(xy, v))], (9_990, None, 1.0, 2.0)], "id long, x double, y double, v double")
    got = {r["id"]: r["density"] for r in neighbours.kde(df, 0.3, df["v"]).collect()}
    want = np.exp(-((xy[:, None] - xy[None]) ** 2).sum(axis=2) / (2 * 0.3**2)) @ v / (2 * np.pi * 0.3**2 * (v.sum() + 2))
    assert len(got) == len(xy) + 1 and abs(got[9_990] - 2 / (2 * np.pi * 0.3**2 * (v.sum() + 2))) < 1e-15
    assert np.allclose([got[i] for i in range(len(xy))], want, atol=1e-11 * want.max(), rtol=1e-7)
