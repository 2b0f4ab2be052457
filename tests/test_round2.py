from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from terravane.operators import detect, geometry, graph, overlay, ranking
from terravane.functions.geo import haversine_np


def test_quantiles_without_a_map_of_values(spark):
    g = np.random.default_rng(3)
    a, b = g.normal(size=30_000), np.round(g.exponential(size=30_000), 1)
    df = spark.createDataFrame([(float(x), float(y) if y < 4 else None) for x, y in zip(a, b)], "a double, b double")
    qs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = ranking.quantiles(df, {"a": qs, "b": qs}, accuracy=100)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, qs))).alias(c) for c in ("a", "b")]).first()
    assert got["a"] == want["a"] and got["b"] == want["b"]
    assert ranking.quantiles(df.limit(0), {"a": [0.5]}) == {"a": [None]}


def test_ranks_of_few_values_are_not_shuffled(spark):
    df = spark.range(2_000).select("id", (F.col("id") % 7).cast("double").alias("v"))
    few, many = ranking.percent_ranks(df, {"v": "p"}), ranking.percent_ranks(df, {"v": "p"}, few=0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert "Exchange hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()


def test_ablation_keeps_no_map_of_all_values(spark):
    df = spark.range(5_000).select((F.rand(1)).alias("a"), F.rand(2).alias("b"))
    plan = detect.ablation(df, {"a": 0.5, "b": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def test_nearest_of_a_large_right_side(spark):
    g = np.random.default_rng(5)
    schema = "id long, lat double, lon double"
    r = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(g.uniform(5, 6, 300), g.uniform(179.5, 180.5, 300)))]
    r = [(i, a, b - 360 if b > 180 else b) for i, a, b in r]
    r.append((900, *r[0][1:]))
    q = [*[(i, float(a), float(b)) for i, (a, b) in enumerate(zip(g.uniform(5, 6, 60), g.uniform(179, 180, 60)))], (98, -60.0, 20.0), (99, *r[0][1:]), (100, None, 1.0)]
    got = geometry.nearest_join(spark.createDataFrame(q, schema), spark.createDataFrame(r, schema), max_right=10).collect()
    want = {(100, None)}
    for i, a, b in q[:-1]:
        d = haversine_np(np.full(len(r), a), np.full(len(r), b), np.array([x[1] for x in r]), np.array([x[2] for x in r]))
        want |= {(i, r[k][0]) for k in np.flatnonzero(d == d.min())}
    assert {(x["left_id"], x["right_id"]) for x in got} == want and len(got) == len(want) == 64


def test_ensemble_keeps_no_map_of_all_values(spark):
    df = spark.range(5_000).select("id", F.rand(1).alias("score_a"), F.rand(2).alias("score_b"))
    out = detect.ensemble(df, {"score_a": 0.5, "score_b": 0.5})
    assert "percentile(" not in out._jdf.queryExecution().executedPlan().toString()
    edge = df.agg(F.percentile(0.5 * F.col("score_a") + 0.5 * F.col("score_b"), 0.99)).first()[0]
    assert out.where("outlier_99").count() == out.where(F.col("outlier_score") >= edge).count() == 50


def shapes(spark, n, seed, kinds):
    g = np.random.default_rng(seed)
    out = [(-1, None), (None, "POINT (3 3)"), (-2, "POINT EMPTY")]
    for i in range(n):
        x, y, w, h = (int(v) for v in (*g.integers(0, 12, 2), *g.integers(1, 5, 2)))
        out.append((i, {0: f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))", 1: f"LINESTRING ({x} {y}, {x + w} {y})", 2: f"POINT ({x} {y})", 3: f"POLYGON (({x} {y}, {x + w} {y}, {x} {y + h}, {x} {y}))"}[kinds[i % len(kinds)]]))
    return spark.createDataFrame(out, "id long, geometry string")


def test_left_join_within_moves_no_pairs(spark, monkeypatch):
    left, right = shapes(spark, 60, 1, (0, 1, 2, 3)), shapes(spark, 50, 2, (0, 0, 3, 1))
    got = overlay.spatial_join(left, right, "within", "left")
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(overlay, "MAX_SENT", 0)
    assert sorted(map(str, got.collect())) == sorted(map(str, overlay.spatial_join(left, right, "within", "left").collect()))


def test_difference_moves_no_pairs(spark, monkeypatch):
    left, right = shapes(spark, 40, 3, (0, 0, 3)), shapes(spark, 15, 4, (0, 0, 0, 3))
    area = lambda df: {r["left_id"]: round(r["area"], 9) for r in df.collect()}
    got = overlay.overlay(left, right, "difference")
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(overlay, "MAX_SENT", 0)
    assert area(got) == area(overlay.overlay(left, right, "difference")) != {}


def test_centrality_of_a_large_component_in_shares(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_COMPONENT", 5)
    g = np.random.default_rng(9)
    pairs = {tuple(sorted(map(int, p))) for p in g.integers(0, 30, (60, 2)) if p[0] != p[1]}
    edges = spark.createDataFrame([(a, b, float(g.uniform(1, 9))) for a, b in pairs], "src long, dst long, weight double")
    nodes = spark.range(32)
    labels = nodes.select("id", F.when(F.col("id") < 30, 0).otherwise(F.col("id")).cast("long").alias("component"))
    one, many = (sorted(map(tuple, graph.centrality(nodes, edges, labels, share=s).collect())) for s in (100, 4))
    assert len(one) == 32 and np.allclose(one, many) and max(x[1] for x in one) > 0
