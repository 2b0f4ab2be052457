from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators import overlay, ranking


def test_ranks_of_many_values_join_nothing(spark):
    g = np.random.default_rng(7)
    inf, nan = float("inf"), float("nan")
    values = [*np.round(g.normal(size=3_000), 3), *[0.25] * 900, *[0.0, -0.0] * 40, *[inf] * 300, *[-inf] * 9, *[nan, None] * 50, 1.7976931348623157e308, -1.7976931348623157e308]
    df = spark.createDataFrame([(i, None if v is None else float(v), i % 5) for i, v in enumerate(values)], "id long, v double, few int")
    got = ranking.percent_ranks(df, {"v": "p", "few": "f"}, few=20, keep=True)
    assert "Join" not in ranking.percent_ranks(df, {"v": "p"}, few=0)._jdf.queryExecution().executedPlan().toString()
    known = np.array([v for v in values if v is not None and v == v])
    want = [0.5 if v is None or v != v else ((known < v).sum() + ((known == v).sum() + 1) / 2) / len(known) for v in values]
    rows = sorted(got.collect())
    assert got.columns == ["id", "v", "few", "p", "f"] and [r["p"] for r in rows] == want
    assert [r["f"] for r in rows] == [r["f"] for r in sorted(ranking.percent_ranks(df, {"few": "f"}).collect())]
    assert {r["p"] for r in ranking.percent_ranks(df.where("v is null"), {"v": "p"}, few=-1).collect()} == {0.5}
    assert got.agg(F.sum("p")).first()[0] == pytest.approx(sum(want))


def test_values_that_hardly_repeat_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ALWAYS_FEW", 10)
    df = spark.range(2_000).select("id", F.rand(1).alias("v"), (F.col("id") % 50).cast("double").alias("u"))
    plan = lambda outs: ranking.percent_ranks(df, outs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan({"v": "p"}) and "Join" in plan({"u": "p"})


def test_covered_rectangles_meet_nothing(spark, monkeypatch):
    g = np.random.default_rng(3)

    def rectangles(n, wide, at):
        x, y = np.round(g.uniform(-at, at, (2, n)), 1)
        w, h = np.round(g.uniform(0.1, wide, (2, n)), 1)
        return [(i, f"POLYGON (({a} {b}, {a + u:.1f} {b}, {a + u:.1f} {b + v:.1f}, {a} {b + v:.1f}, {a} {b}))") for i, (a, b, u, v) in enumerate(zip(x.tolist(), y.tolist(), w.tolist(), h.tolist()))]

    left, right = rectangles(150, 2, 6) + [(900, "POLYGON ((0 0, 2 0, 0 2, 0 0))"), (901, None), (902, "POLYGON ((9 9, 8 9, 8 8, 9 8, 9 9))")], rectangles(400, 3, 5) + [(800, "POINT (0 0)"), (801, "POLYGON ((5 5, 6 5, 5 6, 5 5))")]
    left, right = (spark.createDataFrame(rows, "id long, geometry string") for rows in (left, right))
    sent = overlay._sent(right)
    area = sent.flat & (sent.box[:, 0] < sent.box[:, 2])
    outer = sent.outer(area)
    outer.fill(outer.flat & (outer.box[:, 0] < outer.box[:, 2]))
    assert set(outer.ids) < set(sent.ids) and {800, 801} <= set(outer.ids)
    boxes = overlay._Boxes([r["geometry"] for r in left.collect()])
    covered = outer.covers(boxes.box)
    areas = lambda: {r["left_id"]: round(r["area"], 6) for r in overlay.overlay(left, right, "difference").collect() if r["area"] > 1e-9}
    got = areas()
    assert covered.sum() > 5 and not set(np.flatnonzero(covered).tolist()) & set(got)
    monkeypatch.setattr(overlay, "MAX_SENT", 0)
    assert got == areas() and len(got) > 5


def test_rectangles_are_read_as_shapes_are():
    texts = ["POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))", "polygon((0 0,0 1,2.5 1,2.5 0,0 0))", "POLYGON ((0 0, 2 0, 2 1, 0 1, 0 2))", "POLYGON ((0 0, 2 1, 2 1, 0 1, 0 0))", "POLYGON ((0 0, 2 0, 0 0, 2 0, 0 0))", "POLYGON ((0 0, 0 0, 0 0, 0 0, 0 0))",
             "POLYGON Z ((0 0 1, 2 0 1, 2 1 1, 0 1 1, 0 0 1))", "POLYGON ((-1e2 0, 2 0, 2 1, -1e2 1, -1e2 0))", "POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0), (1 0, 2 0, 2 1, 1 1, 1 0))", None, "", "POINT (1 1)", "LINESTRING (0 0, 2 0)"]
    rows, box = overlay._rectangles(overlay.pa.array(texts))
    assert rows.tolist() == [0, 1] and box.tolist() == [[0, 0, 2, 1], [0, 0, 2.5, 1]]
    made = overlay._Boxes(texts)
    for k, text in enumerate(texts):
        shape = overlay.planar.read(text)
        b = shape.box()
        assert np.array_equal(made.box[k], b or [np.nan] * 4, equal_nan=True) and made.flat[k] == (b is not None and overlay._flat(shape)) and made.area[k] == bool(shape.polygons)
