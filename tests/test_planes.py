from __future__ import annotations

import sqlite3
import struct

import numpy as np
import pytest

from terravane.functions import planar as P
from terravane.operators import overlay
from terravane.sources import files

SQUARE, INNER = "POLYGON((0 0,4 0,4 4,0 4,0 0))", "POLYGON((1 1,2 1,2 2,1 2,1 1))"
HOLED = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))"
CASES = [
    (SQUARE, INNER, "intersects contains covers"), (INNER, SQUARE, "intersects within covered_by"), (HOLED, INNER, "intersects touches"),
    (SQUARE, SQUARE, "intersects within contains covers covered_by"), (HOLED, SQUARE, "intersects within covered_by"),
    ("LINESTRING(-1 2,5 2)", SQUARE, "intersects crosses"), ("LINESTRING(0 0,4 0)", SQUARE, "intersects touches covered_by"), ("LINESTRING(1 3,3 3)", SQUARE, "intersects within covered_by"),
    ("LINESTRING(4 4,5 5)", SQUARE, "intersects touches"), ("LINESTRING(0 0,2 2)", "LINESTRING(0 2,2 0)", "intersects crosses"), ("LINESTRING(0 0,2 0)", "LINESTRING(1 0,3 0)", "intersects overlaps"),
    ("LINESTRING(0 0,2 0)", "LINESTRING(2 0,3 0)", "intersects touches"), ("LINESTRING(0 0,2 0)", "LINESTRING(1 0,1 2)", "intersects touches"),
    ("POINT(1 1)", SQUARE, "intersects within covered_by"), ("POINT(0 1)", SQUARE, "intersects touches covered_by"), ("POINT(1 1)", "POINT(1 1)", "intersects within contains covers covered_by"),
    ("MULTIPOINT((1 1),(9 9))", SQUARE, "intersects crosses"), ("POINT(0 0)", "LINESTRING(0 0,2 0)", "intersects touches covered_by"), ("POINT(1 0)", "LINESTRING(0 0,2 0)", "intersects within covered_by"),
    (SQUARE, "POLYGON((4 0,8 0,8 4,4 4,4 0))", "intersects touches"), (SQUARE, "POLYGON((2 2,8 2,8 8,2 8,2 2))", "intersects overlaps"), (SQUARE, "POLYGON((4 4,5 4,5 5,4 4))", "intersects touches"),
    ("POINT(9 9)", SQUARE, ""), ("POINT EMPTY", SQUARE, ""), (None, SQUARE, ""), ("{broken", SQUARE, ""),
]


@pytest.mark.parametrize(("a", "b", "want"), CASES)
def test_relations(a, b, want):
    assert {k for k, v in P.relate(P.read(a), P.read(b)).items() if v} == set(want.split())
    turned = {"within": "contains", "contains": "within", "covers": "covered_by", "covered_by": "covers"}
    assert {k for k, v in P.relate(P.read(b), P.read(a)).items() if v} == {turned.get(k, k) for k in want.split()}


def test_areas_add_up():
    g = np.random.default_rng(0)

    def star(n, x):
        t, r = (np.arange(n) + g.uniform(0, 0.8, n)) * 2 * np.pi / n, g.uniform(1, 3, n)
        return [np.stack([x + r * np.cos(t), r * np.sin(t)], axis=1)]

    for _ in range(60):
        a, b = star(9, 0), star(7, 1)
        i, u, d, s = (P.total_area(P.combine([a], [b], P.OVERLAYS[o])) for o in ("intersection", "union", "difference", "symmetric_difference"))
        assert max(abs(i + u - P.ring_area(a[0]) - P.ring_area(b[0])), abs(d + i - P.ring_area(a[0])), abs(s - u + i)) < 1e-9
    bow = P.read("POLYGON((0 0,2 2,2 0,0 2,0 0))")
    assert P.crossing_itself(bow) and not P.crossing_itself(P.read(HOLED)) and abs(P.total_area(P.combine(bow.polygons, [], P.OVERLAYS["union"])) - 2) < 1e-12
    assert P.combine([], [], P.OVERLAYS["union"]) == []
    twice = P.read('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,1],[0,0]]],[[[0,0],[1,0],[1,1],[0,1],[0,0]]]]}')
    assert abs(P.total_area(P.combine(twice.polygons, [], P.OVERLAYS["union"])) - 1) < 1e-12


def test_joins_keep_odd_rows(spark):
    schema = "id long, geometry string, area string"
    left = spark.createDataFrame([(1, SQUARE, "x"), (2, None, "x"), (3, "POINT(100 100)", "x"), (None, SQUARE, "x"), (4, "LINESTRING(-1e6 2,1e6 2)", "x")], schema)
    right = spark.createDataFrame([(10, INNER, "y"), (11, "", "y"), (12, "POLYGON((-1e6 -1e6,1e6 -1e6,1e6 1e6,-1e6 1e6,-1e6 -1e6))", "y")], schema)
    inner = {tuple(r) for r in overlay.spatial_join(left, right).collect()}
    assert inner == {(1, 10), (1, 12), (3, 12), (4, 10), (4, 12)}
    both = [tuple(r) for r in overlay.spatial_join(left, right, "contains", "left").collect()]
    assert sorted(both, key=str) == sorted([(1, 10), (2, None), (3, None), (None, None), (4, None)], key=str)
    assert overlay.spatial_join(left.limit(0), right).count() == 0 and overlay.spatial_join(left, right.limit(0)).count() == 0
    union = {(r["left_id"], r["right_id"]): r["area"] for r in overlay.overlay(left.where("id = 1"), right.where("id = 10"), "union").collect()}
    assert {k: round(v, 9) for k, v in union.items()} == {(1, 10): 1.0, (1, None): 15.0}
    corridor = overlay.buffers(spark.createDataFrame([(1, "LINESTRING(-75 6,-75 6.01)"), (2, None)], "id long, geometry string"), 100.0, metric=True).collect()
    assert abs(corridor[0]["area"] - (2 * 100 * 1111.95 + np.pi * 100**2)) < 500 and corridor[1]["area"] is None
    with pytest.raises(ValueError):
        overlay.spatial_join(left, right, "near")


def wkb(polygon):
    out = struct.pack("<BII", 1, 3, len(polygon))
    for ring in polygon:
        out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    return out


RING, HOLE = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]


def test_readers_keep_areas(spark, tmp_path):
    multi = struct.pack("<BII", 1, 6, 2) + wkb([RING]) + wkb([RING, HOLE])
    assert [files.wkb_place(b)[2][:12] for b in (wkb([RING]), multi)] == ["POLYGON ((0.", "MULTIPOLYGON"]
    assert [len(p) for p in P.read(files.wkb_place(multi)[2]).polygons] == [1, 2]
    assert files.wkb_place(None) == files.wkb_place(b"\x01\x02") == (None, None, None)
    measured = struct.pack("<BI", 1, 1001) + struct.pack("<ddd", 1.0, 2.0, 3.0)
    assert files.wkb_place(measured) == (1.0, 2.0, "POINT (1.0 2.0)")
    con = sqlite3.connect(str(tmp_path / "a.gpkg"))
    con.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    con.execute("create table t (name text, geom blob)")
    con.execute("insert into gpkg_geometry_columns values ('t', 'geom')")
    con.execute("insert into t values ('a', ?)", (b"GP\0\x01" + struct.pack("<i", 4326) + wkb([RING, HOLE]),))
    con.commit()
    con.close()
    got = files.read_geopackage(spark, str(tmp_path)).first()
    assert got["lon"] is None and abs(P.total_area(P.combine(P.read(got["geometry"]).polygons, [], P.OVERLAYS["union"])) - 15) < 1e-9
    body = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, 10, 0, 5) + b"".join(struct.pack("<dd", *p) for p in RING + HOLE)
    x, y, text = files._shp_place(body)
    assert x is None and [len(p) for p in P.read(text).polygons] == [2]
    line = struct.pack("<i4d2ii", 3, 0, 0, 1, 1, 1, 2, 0) + struct.pack("<4d", 0, 0, 1, 1)
    assert P.read(files._shp_place(line)[2]).lines[0].tolist() == [[0, 0], [1, 1]]
    spark.createDataFrame([(1, bytearray(wkb([RING]))), (2, None)], "id int, geometry binary").write.parquet(str(tmp_path / "p"))
    rows = {r["id"]: r["geometry_wkt"] for r in files.read_parquet(spark, str(tmp_path / "p")).collect()}
    assert rows[1].startswith("POLYGON") and rows[2] is None
