from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from terravane.functions.geo import haversine_np, in_polygon, polygons, with_position
from terravane.operators import nearby, spikes


def brute_pairs(ids, lat, lon, r):
    d = haversine_np(lat[:, None], lon[:, None], lat[None], lon[None])
    i, j = np.nonzero((d <= r) & (ids[:, None] < ids[None]))
    return {(int(ids[a]), int(ids[b])) for a, b in zip(i, j)}


def cloud(seed=3, n=900):
    g = np.random.default_rng(seed)
    lat = np.concatenate([g.normal(10, 0.01, n), g.normal(-3, 0.003, n // 3), [89.9999, 89.9999, -90.0, 0.0, 0.0, 5.0], np.full(40, 12.5)])
    lon = np.concatenate([g.normal(20, 0.01, n), g.normal(50, 0.003, n // 3), [0.0, 180.0, 7.0, 179.9999, -179.9999, 5.0], np.full(40, -60.25)])
    return np.arange(1, len(lat) + 1), lat, lon


def test_near_pairs_against_brute_force(spark):
    ids, lat, lon = cloud()
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(ids, lat, lon)], "id long, lat double, lon double")
    for r, kw in ((150.0, {"cell_rows": 60}), (150.0, {"cell_rows": 60, "hot_rows": 10}), (400.0, {"cell_rows": 10_000}), (150.0, {"cell_rows": 5, "max_pivots": 40})):
        rows = nearby.near_pairs(df, r, **kw).collect()
        got = {(x["key_a"], x["key_b"]) for x in rows}
        assert len(rows) == len(got)
        assert got == brute_pairs(ids, lat, lon, r)


def test_pairs_come_in_slices():
    g = np.random.default_rng(2)
    sizes = g.integers(1, 40, 30)
    starts = np.cumsum(sizes) - sizes
    i, j = g.integers(0, 30, 60), g.integers(0, 30, 60)
    want = sorted((starts[a] + p, starts[b] + q) for a, b in zip(i, j) for p in range(sizes[a]) for q in range(sizes[b]))
    for most in (7, 100, 10**6):
        parts = list(nearby._spread(starts, sizes, i, j, most))
        assert sorted((int(a), int(b)) for p, q in parts for a, b in zip(p, q)) == want
        assert max(len(p) for p, _ in parts) <= max(most, 40)


def test_near_pairs_empty_and_single(spark):
    df = spark.createDataFrame([], "id long, lat double, lon double")
    assert nearby.near_pairs(df, 150.0).count() == 0
    assert nearby.near_pairs(spark.createDataFrame([(1, 2.0, 3.0)], "id long, lat double, lon double"), 150.0).count() == 0


HOLED = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}'
MULTI = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,1],[0,0]]],[[[0,0],[1,0],[1,1],[0,1],[0,0]]],[[[3,3],[5,3],[5,5],[3,5],[3,3]]]]}'


def test_regions_both_ways(spark):
    g = np.random.default_rng(1)
    pts = [(i, float(y), float(x)) for i, (x, y) in enumerate(g.uniform(-1, 6, (400, 2)))] + [(900, 0.0, 2.0), (901, 1.5, 1.0)]
    p = spark.createDataFrame(pts, "id long, lat double, lon double")
    regions = spark.createDataFrame([(1, HOLED), (2, MULTI), (3, '{"type":"Polygon","coordinates":[]}'), (4, None), (5, "{broken"), (6, MULTI), (None, HOLED)], "region_id long, geojson string")
    want = set()
    for k, text in ((1, HOLED), (2, MULTI), (6, MULTI)):
        for rings in polygons(text):
            hit = in_polygon(np.array([x for _, _, x in pts]), np.array([y for _, y, _ in pts]), rings)
            want |= {(pts[i][0], k) for i in np.flatnonzero(hit)}
    for kw in ({}, {"max_regions": 0}):
        rows = [tuple(r) for r in nearby.containing(p, regions, **kw).collect()]
        assert set(rows) == want and len(rows) == len(want)
    assert (900, 1) in want and (901, 1) in want
    assert nearby.containing(p.limit(0), regions).count() == 0


def test_positions(spark):
    rows = [(1, 5.0, 6.0, None), (2, None, None, "POINT (1.5 -2.5)"), (3, float("nan"), 1.0, "SRID=4326;point z(-1e1 2 0)"), (4, 0.0, 0.0, '{"type": "Point", "coordinates": [7, 8]}'), (5, 95.0, 1.0, "POINT EMPTY"), (6, None, 3.0, "POINT(200 1)"), (7, -999.0, -999.0, ""), (8, None, None, "POINT(0 0)")]
    df = spark.createDataFrame(rows, "i int, lat double, lon double, geometry string")
    got = {r["i"]: (r["lat"], r["lon"]) for r in with_position(df, [F.col("i")], F.col("lat"), F.col("lon"), F.col("geometry")).collect()}
    assert got == {1: (5.0, 6.0), 2: (-2.5, 1.5), 3: (2.0, -10.0), 4: (8.0, 7.0)}


def series(n=600, seed=0):
    g = np.random.default_rng(seed)
    h = np.arange(n) % 24
    return np.round(300 + 6 * np.sin(h / 24 * 2 * np.pi) + g.normal(0, 1, n), 1), h, np.arange(n) // 24


def cases(v, h, d, **kw):
    return set(np.flatnonzero(spikes.flag_series(v, h, d, kw.pop("low", 0.0), kw.pop("high", 1000.0), **({"log": False} | kw))))


def test_spike_rules():
    v, h, d = series()
    assert cases(v, h, d) == set()
    s = v.copy()
    s[100] += 25
    s[200:203] -= 30
    s[300:304] += 40  # four together are behaviour
    s[400:] += 35  # so is a change that lasts
    assert cases(s, h, d) == {100, 200, 201, 202}
    t = v.copy()
    t[50:62] = 301.0
    t[80:91] = 302.0
    assert {i for i in cases(t, h, d) if i < 70} >= set(range(50, 62)) and not cases(t, h, d) & set(range(80, 91))
    u = v.copy()
    u[5], u[6], u[7] = np.inf, -1.0, 1000.0
    assert cases(u, h, d) == {5, 6, 7}
    assert cases(np.array([1.0, 900.0]), np.zeros(2, int), np.zeros(2, int)) == set()


def frame(spark, n=500, source="s"):
    v, h, d = series(n)
    v[250] += 40
    rows = [(i, source, "P", f"2024-01-{1 + i // 24:02d}", f"{(i % 24) * 100}.0", float(v[i]), None, float("nan"), "x", 1000 + i) for i in range(n)]
    rows.append((10_000, *rows[250][1:-1], 5))
    rows.append((10_001, *rows[250][1:-1], 6))
    rows.append((10_002, None, None, None, "bad", None, None, None, None, None))
    schema = "row_id long, _source_file string, _api_source string, ACQ_DATE string, ACQ_TIME string, FRP double, BRIGHTNESS double, BRIGHT_T31 double, idx string, received_at long"
    return spark.createDataFrame(rows, schema)


def test_flag_reports_copies_and_survives_blocks(spark):
    limits = spark.createDataFrame([("P", "FRP", 0.0, 1000.0), (None, "FRP", 0.0, 1.0)], "api_source string, field_name string, low_value double, high_value double")
    df = frame(spark).unionByName(frame(spark, source=None).withColumn("row_id", F.col("row_id") + 100_000))
    want = {(r, "FRP") for b in (0, 100_000) for r in (250 + b, 10_000 + b, 10_001 + b)}
    for block in (8_192, 200):
        rows = [tuple(r) for r in spikes.flag(df, limits, log_fields=(), block=block).collect()]
        assert set(rows) == want and len(rows) == len(want)
    assert spikes.flag(df.limit(0), limits).count() == 0
    assert spikes.flag(df, limits.limit(0), log_fields=()).count() == len(want)


def test_esd_limit_decides_and_nothing_is_capped():
    g = np.random.default_rng(4)
    wide = np.append(g.uniform(-6, 6, 300), 8.0)  # past the ratio, but no outlier of a series as wide as this
    assert not spikes.esd_outliers(wide).any() and abs(wide[-1]) > spikes.RATIO
    narrow = np.append(g.normal(0, 1, 300), 8.0)
    assert np.flatnonzero(spikes.esd_outliers(narrow)).tolist() == [300]
    many = np.append(g.normal(0, 0.8, 60), np.full(40, 20.0) * g.choice([-1, 1], 40))
    assert spikes.esd_outliers(many).sum() == 40
    assert spikes.esd_outliers(np.append(g.normal(0, 0.5, 20), [20.0] * 8)).sum() == 8
    assert spikes.esd_outliers(np.zeros(10)).sum() == 0 and len(spikes.esd_outliers(np.zeros(0))) == 0


def test_course_comes_from_the_whole_source(spark):
    n = 24 * 40
    h = np.arange(n) % 24
    v = np.round(300 + 25 * (h == 5) + np.random.default_rng(1).normal(0, 1, n), 1)  # every day at five, so no case
    v[501] += 30
    rows = [(i, "s", "P", f"2024-{1 + i // 24 // 28:02d}-{1 + i // 24 % 28:02d}", f"{(i % 24) * 100}", float(v[i]), None, None, 0) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, _source_file string, _api_source string, ACQ_DATE string, ACQ_TIME string, FRP double, BRIGHTNESS double, BRIGHT_T31 double, received_at long")
    limits = spark.createDataFrame([], "api_source string, field_name string, low_value double, high_value double")
    for block in (8_192, 48):
        assert [r["row_id"] for r in spikes.flag(df, limits, log_fields=(), block=block).collect()] == [501]
    assert spikes.flag(df, limits, block=48, spikes=False).count() == 0
