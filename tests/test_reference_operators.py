from __future__ import annotations

import io
import json
import math
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import distributions as D
from terravane.functions import raster
from terravane.operators import cleaning, core, detect, fitting, geometry, graph, neighbours, ranking, regions, temporal, territory
from terravane.plans import analysis, export, semantics, state
from terravane.sources import files, remote
from terravane.streaming import events

SHAPES = {"lognorm": (0.7,), "gamma": (2.2,), "chi2": (3.0,), "weibull_min": (1.6,), "weibull_max": (1.6,), "t": (4.0,), "pareto": (3.0,), "invgauss": (0.6,), "genextreme": (0.1,), "f": (5.0, 9.0), "beta": (2.9, 5.5)}


@pytest.mark.parametrize("name", list(D.SHAPES))
def test_densities_integrate_to_one(name):
    params = (*SHAPES.get(name, ()), 1.5, 2.0)
    c = D.Cdf(name, params)
    q = c.quantile(0.5)
    assert abs(c(q)[0] - 0.5) < 1e-8
    a, b = c.quantile(0.05), c.quantile(0.95)
    assert abs(D.integral(lambda x: D.pdf(name, params, x), a, b, 200) - 0.9) < 2e-4


def test_quadrature_and_derivatives():
    assert abs(D.integral(lambda x: x**4, -1, 1, 3) - 0.4) < 1e-12
    assert abs(D.integral(lambda x: x, 1, 0, 4) + 0.5) < 1e-12
    with pytest.raises(ValueError):
        D.integral(lambda x: x, 0, math.inf)
    roots = D.inflections("norm", (0.0, 1.0), 4096)["roots"]
    assert np.allclose(roots, [-1, 1], atol=0.02)
    for _, _, _, area, err in D.central_areas("norm", (0.0, 1.0)):
        assert err < 1e-8 and 0 < area < 1


def test_ranks(spark):
    vals = [3.0, 1.0, 3.0, None, float("nan"), 2.0, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    got = {r["id"]: r["p"] for r in ranking.percent_rank(df, "v", "p").collect()}
    assert got == {0: 0.8, 1: 0.2, 2: 0.8, 3: 0.5, 4: 0.5, 5: 0.4, 6: 0.8}
    o = {r["id"]: r["o"] for r in ranking.ordinal01(df, "v", "id", "o").collect()}
    assert [o[i] for i in (1, 5, 0, 2, 6)] == [0, 1 / 6, 2 / 6, 3 / 6, 4 / 6]
    assert ranking.percent_rank(df.limit(0), "v", "p").count() == 0


def points(spark, n=400, seed=2):
    g = np.random.default_rng(seed)
    xy = np.concatenate([g.normal(0, 0.1, (n // 2, 2)), g.uniform(-3, 3, (n - n // 2 - 6, 2)), np.zeros((6, 2))])
    return xy, spark.createDataFrame([(i, float(x), float(y), float(x + y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double, v double")


def test_knn_is_exact_across_tiles(spark):
    xy, df = points(spark)
    want = {}
    for i in range(len(xy)):
        d2 = ((xy - xy[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(xy)), d2)) if j != i][:5]
        want[i] = order
    got = {}
    for r in neighbours.knn(df, 5, rows=40).orderBy("i", "rank").collect():
        got.setdefault(r["i"], []).append(r["j"])
    assert got == want


def test_components_paths_and_trees(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (10, 11, 2.0), *[(100 + i, 101 + i, 1.0) for i in range(40)]], "src long, dst long, weight double")
    n = spark.createDataFrame([(i,) for i in [1, 2, 3, 10, 11, 50, *range(100, 141)]], "id long")
    c = {r["id"]: r["component"] for r in graph.components(n, e).collect()}
    assert c[3] == 1 and c[11] == 10 and c[50] == 50 and c[140] == 100
    assert {r["id"]: r["distance"] for r in graph.shortest_paths(e, 1).collect()} == {1: 0.0, 2: 1.0, 3: 2.0}
    assert graph.spanning_tree(n, e).where("component = 1").agg(F.sum("weight")).first()[0] == 2.0
    b = {r["id"]: r["betweenness"] for r in graph.centrality(n, e).collect()}
    assert b[2] > 0 and b[1] == 0


def test_paths_of_many_edges_are_whole(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(105)] + [(0, 105, 500.0)], "src long, dst long, weight double")
    got = {r["id"]: r["distance"] for r in graph.shortest_paths(e, 0).collect()}
    assert got == {i: float(i) for i in range(106)}
    with pytest.raises(RuntimeError):
        graph.shortest_paths(e, 0, rounds=3)
    with pytest.raises(RuntimeError):
        graph.components(spark.range(106), e, rounds=1)


def test_corridors_have_a_density_null(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in (*range(5), *range(10, 15))], "src long, dst long, weight double")
    n = spark.createDataFrame([(i,) for i in (*range(6), *range(10, 16), *range(50, 90))], "id long")
    dens = n.select("id", F.when(F.col("id") < 6, 1.0).when(F.col("id") < 16, 0.0).otherwise(0.4).alias("density"))
    got = [(r["component"], r["p_value"]) for r in graph.corridors(n, e, dens).collect()]
    assert got == [(0, 0.01), (10, 1.0)]


def test_dbscan_and_lof(spark):
    df = spark.createDataFrame([(i, float(i % 5) / 10, float(i // 5) / 10, 0.0) for i in range(25)] + [(90, 9.0, 9.0, 0.0)], "id long, x double, y double, v double")
    lab = {r["id"]: r["cluster"] for r in neighbours.dbscan(df, 0.11, 4).collect()}
    assert lab[90] == -1 and {lab[i] for i in range(25)} == {min(lab[i] for i in range(25) if lab[i] >= 0)}
    s = {r["id"]: r["lof"] for r in neighbours.lof(neighbours.knn(df, 4)).collect()}
    assert max(s, key=s.get) == 90


def test_spd_and_procrustes():
    a = np.array([[2, 0.2], [0.2, 1]])
    assert detect.affine_distance(a, a) < 1e-9
    g = np.random.default_rng(0).normal(size=(6, 2))
    t = np.array([[0, -1], [1, 0]])


def test_robust_distance_finds_outliers(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(400, 3))
    x[:40] += 12
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    d = {r["id"]: r["distance"] for r in detect.robust_mahalanobis(df, ["a", "b", "c"]).collect()}
    assert min(d[i] for i in range(40)) > np.quantile([d[i] for i in range(40, 400)], 0.99)


def test_small_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("b", 10.0), ("c", None)], "k string, v double")
    got = {r["k"]: r["gini"] for r in regions.gini(df, ["k"], "v").collect()}
    assert abs(got["a"]) < 1e-12 and got["b"] > 0.6 and "c" not in got
    assert regions.kolmogorov_p(0.0, 100) == 1.0 and regions.kolmogorov_p(0.5, 100) < 1e-6
    t = spark.createDataFrame([("s", i, 100.0 if i == 40 else 1.0) for i in range(80)], "k string, t int, v double")
    z = temporal.rolling_deviation(t, ["k"], ["t"], "v", 21).orderBy(F.desc("robust_z")).first()
    assert z["t"] == 40
    assert [r["t"] for r in temporal.change_points(t, ["k"], ["t"], "v").orderBy("t").collect()] == [40, 41]
    q = cleaning.quality(spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (200.0, 1.0), (None, 1.0)], "lon double, lat double"), "lon", "lat").first()
    assert (q["repeated_positions"], q["out_of_range"], q["missing_positions"], q["gate"]) == (1, 1, 1, "blocked")


def test_raster(spark):
    df = spark.createDataFrame([(0.2, 0.6, 0.3, 0.3, 0.2), (-1.0, 1.0, 0.0, 0.0, 0.0)], "red double, nir double, green double, swir16 double, swir22 double")
    r = df.select(*[raster.index(n).alias(n) for n in raster.INDICES]).collect()
    assert abs(r[0]["ndvi"] - 0.5) < 1e-9 and abs(r[0]["ndmi"] - 1 / 3) < 1e-9 and r[1]["ndvi"] is None
    s = spark.range(1).select(raster.scale_band("landsat", "red", F.lit(10000.0)), raster.scale_band("landsat", "thermal", F.lit(40000.0))).first()
    assert abs(s[0] - 0.075) < 1e-9 and abs(s[1] - 12.5708) < 1e-6
    assert [r[0] for r in spark.createDataFrame([(q,) for q in (4, 8, 9, 6, 3)], "q int").select(raster.clear("sentinel2", F.col("q"))).collect()] == [True, False, False, True, False]
    with pytest.raises(ValueError):
        raster.index("nope")


def test_projection_and_clipping(spark):
    x, y = geometry.utm(F.lit(48.8582), F.lit(2.2945), 31)
    e, n = spark.range(1).select(x, y).first()
    assert abs(e - 448251.795) < 0.01 and abs(n - 5411932.678) < 0.01
    sq = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    right = [(i, i / 100, i / 90) for i in range(50)]
    schema = "id long, lat double, lon double"
    left, r = spark.createDataFrame([(1, 0.101, 0.112), (2, 60.0, 60.0)], schema), spark.createDataFrame(right, schema)
    a = {(x["left_id"], x["right_id"]) for x in geometry.nearest_join(left, r, 5_000.0).collect()}
    b = {(x["left_id"], x["right_id"]) for x in geometry.nearest_join(left, r, 5_000.0, max_right=10).collect()}
    assert a == b == {(1, 10), (2, None)}


def test_incident_state(spark):
    empty = spark.createDataFrame([], "fingerprint string, key string, rule_id int, severity string, status string, occurrences int, run string")
    m = lambda rows: spark.createDataFrame(rows, "key string, rule_id int, severity string")
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "key string")
    s1 = territory.merge_incidents(empty, m([("a", 1, "medium"), ("b", 1, "high")]), keys(["a", "b"]), F.lit("1"))
    s2 = territory.merge_incidents(s1, m([("a", 1, "critical")]), keys(["a"]), F.lit("2"))
    s3 = territory.merge_incidents(s2, m([("c", 2, "info")]), keys(["a", "b", "c"]), F.lit("3"))
    got = {r["fingerprint"]: (r["status"], r["severity"], r["occurrences"]) for r in s2.collect()}
    assert got == {"a:1": ("escalated", "critical", 2), "b:1": ("open", "high", 1)}
    assert {r["fingerprint"]: r["status"] for r in s3.collect()} == {"a:1": "resolved", "b:1": "resolved", "c:2": "open"}


def test_trajectory_watch(spark):
    rows = [("t", float(d), v, 100.0 + 2 * d) for d, v in enumerate([0.50, 0.51, 0.49, 0.52, 0.50, 0.90])]
    t = territory.trajectory(spark.createDataFrame(rows, "k string, t double, a double, b double"), "k", "t", ["a", "b"])
    assert t.where("speed is not null").count() == 5 and t.where("acceleration is not null").count() == 4
    assert territory.watch(t, "k").first()["status"] in ("NORMAL", "ELEVATED", "HIGH")
    two = territory.trajectory(spark.createDataFrame(rows[:2], "k string, t double, a double, b double"), "k", "t", ["a", "b"])
    assert territory.watch(two, "k").first()["departure_level"] == "BASELINE_BUILDING"


def _gpkg(path):
    con = sqlite3.connect(path)
    con.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    con.execute("create table pts (name text, geom blob)")
    con.execute("insert into gpkg_geometry_columns values ('pts', 'geom')")
    con.execute("insert into pts values ('a', ?)", (b"GP\0\x01" + struct.pack("<i", 4326) + b"\x01" + struct.pack("<I", 1) + struct.pack("<dd", 3.5, 4.5),))
    con.commit()
    con.close()


def _shp_zip(path):
    rec = struct.pack(">ii", 1, 10) + struct.pack("<idd", 1, 7.0, 8.0)
    shp = b"\0" * 100 + rec
    field = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    dbf = bytes([3, 0, 0, 0]) + struct.pack("<IHH", 1, 32 + 32 + 1, 6) + b"\0" * 20 + field + b"\x0d" + b" " + b"abc  "
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("p.shp", shp), z.writestr("p.dbf", dbf), z.writestr("p.shx", b"")


def _xlsx(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="B2"><v>2.5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>lat</t></si><si><t>lon</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Latitud,Longitud,v\n1.0,2.0,x\n99,2,y\n")
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "q"}, "geometry": {"type": "Point", "coordinates": [5, 6]}}]}))
    _gpkg(str(tmp_path / "b.gpkg")), _shp_zip(str(tmp_path / "c.zip")), _xlsx(str(tmp_path / "d.xlsx"))
    c = files.as_points(files.read_csv(spark, str(tmp_path / "a.csv"))).collect()
    assert [(r["lat"], r["lon"]) for r in c] == [(1.0, 2.0)]
    one = lambda df: [(r["lon"], r["lat"], dict(r["properties"])) for r in df.collect()]
    assert one(files.read_json(spark, str(tmp_path / "g.geojson"))) == [(5.0, 6.0, {"n": "q"})]
    assert one(files.read_geopackage(spark, str(tmp_path))) == [(3.5, 4.5, {"name": "a"})]
    assert one(files.read_shapefile(spark, str(tmp_path))) == [(7.0, 8.0, {"name": "abc"})]
    assert one(files.read_excel(spark, str(tmp_path))) == [(2.5, 1.5, {"lat": "1.5", "lon": "2.5"})]
    assert files.scan(spark, str(tmp_path)).count() == 4
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../x.shp", b"")
    with pytest.raises(ValueError):
        files.parse_shp_zip(bad.getvalue())


def test_remote_sources(spark):
    fire = "latitude,longitude,bright_ti4,bright_ti5,frp,scan,track,acq_date,acq_time,satellite,confidence\n1.5,2.5,330.1,290,7,0.4,0.5,2024-01-01,1230,N,n\n"
    sky = json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.0, 3.0], "relative_humidity_2m": [50, 70], "precipitation": [1.0, 2.0], "wind_speed_10m": [2.0, 4.0]}})
    rows = remote.fires(spark, lambda o: fire, "VIIRS_SNPP_NRT", (-10.0, -10.0, 10.0, 10.0), 2).collect()
    assert len(rows) == 2 and rows[0]["BRIGHTNESS"] == 330.1 and rows[0]["lat"] == 1.5
    with pytest.raises(ValueError):
        remote.check_fire_request("NOPE", (-10, -10, 10, 10), 1)
    d = remote.daily_weather(remote.weather(spark, lambda o: sky)).first()
    assert (d["temperature"], d["precipitation"]) == (2.0, 3.0)
    items = spark.createDataFrame([(json.dumps({"id": "s", "properties": {"datetime": "2024-01-01T00:00:00Z", "eo:cloud_cover": 10}, "assets": {"red": "u", "nir": "u"}}),), (json.dumps({"id": "t", "properties": {"eo:cloud_cover": 90}, "assets": {}}),)], "item string")
    got = remote.scenes(items, 50, {"ndvi": ["red", "nir"], "ndmi": ["nir", "swir16"]}).collect()
    assert [(r["id"], r["derivable"]) for r in got] == [("s", ["ndvi"])]
    assert remote.box_of('{"type":"Polygon","coordinates":[[[-76,5],[-75,5],[-75,6],[-76,6],[-76,5]]]}') == [-76, 5, -75, 6]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0, "normal", True, 0.5), (2, 2.0, 3.0, "99", False, 0.9)], "id long, lon double, lat double, outlier_level string, outlier_90 boolean, score double")
    export.write_layer(df, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).where("outlier_level = '99'").count() == 1
    assert export.map_points(df, "outlier_90", "id", 1).first()["id"] == 1
    assert export.top_rows(df, "score", 1).first()["id"] == 2
    assert export.display_histogram(df, "score").agg(F.sum("n")).first()[0] == 2
    assert "&lt;" in export.html_report("<t>", {}) and "**a**" in export.markdown({"a": 1})
    assert json.loads(export and files.feature_text(df, "lon", "lat", ["id"]).first()[0])["geometry"]["coordinates"] == [2.0, 3.0]


def test_stream_matches_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    (tmp_path / "in").mkdir()
    spark.read.parquet(src).write.parquet(str(tmp_path / "in/e"))
    stream = events.hourly(events.event_stream(spark, str(tmp_path / "in/e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    a = {(str(r["hour"]), r["event_type"]): r["n"] for r in spark.table("hours").collect()}
    b = {(str(r["h"]), r["event_type"]): r["n"] for r in spark.read.parquet(src).groupBy(F.date_trunc("hour", F.col("ts")).alias("h"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert a == b


def test_semantics(spark):
    df = spark.createDataFrame([(i, float(i), 1.0 * i, 2.0 * i, "t") for i in range(40)], "id long, Latitude double, longitud double, frp double, label string")
    domain = {"id": "x", "variables": ["FRP"], "aliases": [["FRP", "fire_power"]], "weights": {"a": 2.0}}
    made = semantics.contract(df, domain)
    roles = {r["semantic"]: (r["column"], r["confidence"], r["source"]) for r in made.collect()}
    assert roles["latitude"] == ("Latitude", 1.0, "alias") and roles["longitude"][0] == "longitud" and roles["FRP"] == ("frp", 1.0, "domain_pack")
    out = semantics.with_aliases(df, made).columns
    assert out[: len(df.columns)] == df.columns and set(out) - set(df.columns) == {"longitude"}
    packs = [{"id": "a", "variables": ["NDVI"]}, {"id": "b", "variables": ["price"]}]
    assert [tuple(r) for r in semantics.infer_domain(spark, ["ndvi", "soil"], packs).collect()] == [("a", 2.6, 2.6 / 6), ("b", 0.0, 0.0)]
    assert semantics.infer_domain(spark, [], []).count() == 0
    conf = semantics.configure(df, domain, variables=["Latitude", "none"], weights={"b": 1.0}, default={"a": 1.0, "c": 3.0}).first()
    assert conf["feature"] == "frp" and conf["variables"] == ["Latitude", "frp"] and conf["weights"] == {"a": 2.0, "b": 1.0, "c": 3.0}
    assert semantics.plan(df, {"id": "x", "variables": ["frp"]}).first()["feature"] == "frp"
    bare = semantics.plan(df.limit(0), {"id": "x"}).first()
    assert not bare["ready"] and bare["feature"] is None and "fewer than two variables" in bare["blockers"]
    two = semantics.contract(spark.createDataFrame([(1.0, 2.0)], "frp double, frp_two double"), {"id": "x", "variables": ["frp", "FRP_two"]})
    assert {r["semantic"]: r["column"] for r in two.collect()} == {"frp": "frp", "FRP_two": "frp_two"}


def test_state_log(spark, tmp_path):
    log = state.Log(spark, str(tmp_path / "log"), ("k",))
    mk = lambda rows, s="k string, v int": spark.createDataFrame(rows, s)
    log.append(mk([("a", 1), ("b", 2)]), 1)
    log.append(mk([("a", None), ("a", 5)]).withColumn("o", F.monotonically_increasing_id()), 2)
    log.append(mk([("b", 0)]), 3, deleted=True)
    assert {(r["k"], r["v"]) for r in log.current().select("k", "v").collect()} <= {("a", 5), ("a", None)}
    assert {r["k"]: r["v"] for r in log.upserted().select("k", "v").collect()}["a"] == 5
    assert log.history(1).first()["k"] == "b" and log.version() == 2
    assert state.run_with_retry(lambda: 1 / 0, 2, lambda: "x") == "x"


def test_core_engine(spark):
    at, best, curve = core.grey_wolf(lambda p: (p**2).sum(axis=1), [(-5, 5)] * 2, seed=7)
    assert best < 1e-3 and curve[0] >= best and np.array_equal(at, core.grey_wolf(lambda p: (p**2).sum(axis=1), [(-5, 5)] * 2, seed=7)[0])
    h = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 10.0), ("a", 3, 10.0), ("b", 1, 4.0)], "id string, n int, value double")
    f = {r["id"]: r for r in core.forecast(h, "id", "n", "value").collect()}
    assert abs(f["a"]["next_value"] - 10) < 1e-9 and f["b"]["confidence"] == 0.25
    n = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.001, 0.001), ("c", 9.0, 9.0)], "id string, lat double, lon double")
    p = spark.createDataFrame([("a", "b")], "key_a string, key_b string")
    got = {r["id"]: r for r in core.property_intelligence(n, p, h).collect()}
    assert got["a"]["nearby"] == 1 and got["c"]["risk"] is None and got["c"]["next_value"] is None


def test_feature_neighbourhoods(spark):
    g = np.random.default_rng(11)
    x = np.concatenate([g.normal(size=(150, 3)), g.normal(size=(30, 3)) * [6, 0.01, 0.01] + 9])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = {r["id"]: r["spd"] for r in detect.feature_spd(df, ["a", "b", "c"], k=10).collect()}
    whole = np.cov(x, rowvar=False) + np.eye(3) * 1e-6
    for i in (0, 77, 160):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert abs(got[i] - detect.affine_distance(np.cov(x[np.argsort(d)[:10]], rowvar=False) + np.eye(3) * 1e-6, whole)) < 1e-5
    assert np.mean([got[i] for i in range(150, 180)]) > np.mean([got[i] for i in range(150)])


def test_feature_neighbourhoods_are_of_all_rows(spark):
    g = np.random.default_rng(12)
    x = np.concatenate([g.standard_t(3, (24_000, 3)).round(2), g.normal(size=(12, 3)) * [0.3, 0.001, 0.001] + 40, np.full((60, 3), 7.25)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(99_999, None, 1.0, 1.0)], "id long, a double, b double, c double")
    got = {r["id"]: r["spd"] for r in detect.feature_spd(df, ["a", "b", "c"], k=10).collect()}
    assert len(got) == len(x) + 1 and got[99_999] is None
    whole = np.cov(x, rowvar=False) + np.eye(3) * 1e-6
    for i in (0, 5_000, 23_999, 24_000, 24_011, 24_050):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = x[np.lexsort((*x.T[::-1], d))[:10]]
        want = detect.affine_distance(np.cov(near, rowvar=False) + np.eye(3) * 1e-6, whole)
        assert abs(got[i] - want) < 1e-4, i


def test_variables_are_compared_whole(spark):
    g = np.random.default_rng(8)
    rows = [(i, float(g.uniform(0, 1e4)), float(g.uniform(0, 1e4)), i % 2, i, float(v), 1.0 if i < 9 else None) for i, v in enumerate(g.normal(5, 1, 400))]
    got = {r["variable"]: r for r in analysis.compare_variables(spark.createDataFrame(rows, "id long, x double, y double, s int, t int, a double, b double"), ["a", "b"], "s", ["t"], candidates=["norm", "weibull_min"]).collect()}
    assert (got["b"]["status"], got["b"]["n"], got["b"]["distribution"]) == ("insufficient_data", 9, None)
    a = got["a"]
    assert (a["status"], a["n"], a["probability_anomalies_95"], a["temporal_anomalies_95"]) == ("ok", 400, 20, 20)
    assert 0.4 < a["median_tail_area"] < 0.6 and 0 <= a["spatial_anomalies_95"] < 20 and a["fisher_rao"] > 0


def test_fits_recover_the_family(spark):
    g = np.random.default_rng(3)
    df = spark.createDataFrame([(float(v),) for v in g.lognormal(1.0, 0.5, 4_000)], "v double")
    fits = fitting.fit_all(df, "v", ["norm", "expon", "lognorm", "uniform", "gamma"]).collect()
    assert fits[0]["distribution"] == "lognorm"
    for r in fits:
        k = len(r["params"])
        assert abs(r["aic"] - (2 * k - 2 * r["log_likelihood"])) < 1e-6
        assert abs(r["fisher_rao"] - 2 * math.acos(math.exp(-r["bhattacharyya"]))) < 1e-6
    with pytest.raises(ValueError):
        fitting.fit_all(df.limit(5), "v")


def test_correlation_p(spark):
    rows = spark.createDataFrame([(float(i), 2.0 * i, (-1.0) ** i) for i in range(1, 6)], "x double, y double, z double")
    got = {(r["a"], r["b"]): r for r in regions.correlations(rows, ["x", "y", "z"]).collect()}
    assert got[("x", "y")]["p_value"] <= 0.001 and 0.5 < got[("x", "z")]["p_value"] <= 1.0
    grid = np.linspace(0.5 * math.sqrt(18 / 0.75), 400, 2_000_001)
    density = math.gamma(9.5) / math.gamma(9) / math.sqrt(18 * math.pi) * (1 + grid**2 / 18) ** -9.5
    assert abs(regions.correlation_p(0.5, 20) - 2 * np.trapezoid(density, grid)) < 1e-8 and math.isnan(regions.correlation_p(0.5, 2))


def test_cases_keep_incidents_without_more(spark):
    i = spark.createDataFrame([(1, "k", 1, "open"), (1, "k", 2, "done"), (2, None, 1, "open")], "incident_id long, object_key string, rec int, status string")
    m = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (None, 9, "c")], "incident_id long, rec int, owner string")
    n = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (None, 7)], "incident_id long, id long")
    o = spark.createDataFrame([("k", 1, "old", "x"), ("k", 2, "new", "y")], "object_key string, version int, name string, status string")
    got = {r["incident_id"]: (r["status"], r["owner"], r["n_notes"], r["name"]) for r in territory.cases(i, m, n, o).collect()}
    assert got == {1: ("done", "b", 2, "new"), 2: ("open", None, 0, None)}
    assert territory.cases(i.limit(0), m, n, o).count() == 0


def test_spanning_tree_of_large_components(spark):
    g = np.random.default_rng(7)
    pairs = {tuple(sorted(map(int, p))) for p in g.integers(0, 60, (150, 2)) if p[0] != p[1]}
    edges = spark.createDataFrame([(a, b, float(g.integers(1, 9))) for a, b in pairs], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in range(60)], "id long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    local, joined = graph.spanning_tree(nodes, edges), graph.spanning_tree(nodes, edges, most=3)
    assert rows(local) == rows(joined) and len(rows(local)) > 40


def test_speed_distances_meet_once(spark):
    rows = [(k, n, float(k * n % 7)) for k in range(1, 9) for n in range(1, 6)] + [(99, 1, None)]
    t = spark.createDataFrame(rows, "k long, n int, speed double")
    got = {(r["a"], r["b"]): r["distance"] for r in territory.speed_distances(t, "k", 3, blocks=3).collect()}
    want = {(a, b): sum((a * n % 7 - b * n % 7) ** 2 for n in (3, 4, 5)) ** 0.5 for a in range(1, 9) for b in range(a + 1, 9)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_series_are_cut_into_blocks(spark):
    g = np.random.default_rng(5)
    rows = [(s, int(g.integers(0, 50)), i, None if i % 11 == 0 else float(g.normal() + 9 * (i % 37 == 0))) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + [None] * 20)]
    df = spark.createDataFrame(rows, "s string, day int, i int, v double")
    rounded = lambda d, c: sorted((r["i"], None if r[c] is None else round(r[c], 9)) for r in d.collect())
    for window in (5, 21):
        whole = temporal.rolling_deviation(df, ["s"], ["day", "i"], "v", window)
        assert rounded(temporal.rolling_deviation(df, ["s"], ["day", "i"], "v", window, block=16), "robust_z") == rounded(whole, "robust_z")
    ordered = [r["v"] for r in df.where("s = 'a'").orderBy("day", "i").collect()]
    by_hand = {i: abs((ordered[i] or 0) - (ordered[i - 1] or 0)) for i in range(1, 300) if ordered[i] is not None and ordered[i - 1] is not None}
    some = temporal.change_points(df.where("s = 'a'"), ["s"], ["day", "i"], "v", limit=0.0, block=16)
    assert {round(r["diff"], 9) for r in some.collect()} <= {round(x, 9) for x in by_hand.values()} | {0.0}
    assert rounded(temporal.change_points(df, ["s"], ["day", "i"], "v", block=16), "change_score") == rounded(temporal.change_points(df, ["s"], ["day", "i"], "v"), "change_score")
    assert temporal.rolling_deviation(df.limit(0), ["s"], ["day", "i"], "v", 5).count() == 0
