"""Territories over time, pixels and geometry over the test tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.common import instant_us, object_key, table
from terravane.functions import raster
from terravane.functions.geo import EARTH_M
from terravane.functions.planar import RELATIONS
from terravane.operators import core, detect, geometry, keys, nearby, temporal, territory
from terravane.operators import overlay as planes
from terravane.operators.history import encode
from terravane.plans import enrichment, semantics, state
from terravane.queries.general import PERIODS_SQL, fire_positions, object_versions
from terravane.queries.general import SQL as GENERAL
from terravane.queries.registry import Registry
from terravane.queries.tabular import WGS_SQL, r, wgs
from terravane.session import cut

R = Registry()
QUERIES, SQL = R.queries, R.sql
_NM = "nm as (select c_nationkey as territory, date_trunc('month', o_orderdate) as month, count(*)::double as n, avg(o_totalprice) as price from orders join customer on o_custkey = c_custkey group by 1, 2), sr as (select territory, epoch_us(month::timestamp) / 86400e6 as t, n, price from nm)"
W4 = "(partition by territory order by t)"


def nation_month(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy(F.col("c_nationkey").alias("territory"), F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("price"))
    return cut(g.select("territory", (F.unix_micros(F.col("month").cast("timestamp")) / F.lit(86_400e6)).alias("t"), "n", "price"))


@R.add(f"with {_NM} select territory, round(t, 6) as t, 'satellite.price' as feature, round(price, 6) as value from sr union all select territory, round(t, 6), 'social.n', n from sr")
def fuse_features(spark, d):
    v = nation_month(spark, d).withColumn("vector", territory.fuse({"social": F.create_map(F.lit("n"), F.col("n")), "satellite": F.create_map(F.lit("price"), F.col("price")), "climate": F.lit(None).cast("map<string,double>")}))
    return territory.long_vectors(v, "territory", "t", "vector").select("territory", r(F.col("t")).alias("t"), "feature", r(F.col("value")).alias("value"))


_LONG = "l as (select territory, t, 'n' as feature, n as value from sr union all select territory, t, 'price', price from sr)"


@R.add(f"""with {_NM}, {_LONG}, p as (select *, quantile_cont(value, 0.5) over w as med, list(value) over w as past, lead(t) over (partition by territory, feature order by t) as nx from l window w as (partition by territory, feature order by t rows between 8 preceding and 1 preceding)),
q as (select *, (select quantile_cont(abs(x - med), 0.5) from (select unnest(past) as x)) as mad from p where nx is null and med is not null)
select territory, round(t, 6) as t, feature, round(value, 6) as value, round(med, 6) as baseline, round((value - med) / greatest(1.4826e0 * mad, 0.1e0 * abs(med), 1e-9), 6) as z, abs((value - med) / greatest(1.4826e0 * mad, 0.1e0 * abs(med), 1e-9)) >= 3.5 as signal from q""")
def temporal_profile(spark, d):
    v = nation_month(spark, d).withColumn("vector", F.create_map(F.lit("n"), F.col("n"), F.lit("price"), F.col("price")))
    return territory.profile(v, "territory", "t", "vector").withColumns({c: r(F.col(c)) for c in ("t", "value", "baseline", "z")})


_TRAJ = f"""{_NM}, s0 as (select *, coalesce(case when stddev_samp(n) over b > 1e-9 then stddev_samp(n) over b end, 1) as sn, coalesce(case when stddev_samp(price) over b > 1e-9 then stddev_samp(price) over b end, 1) as sp from sr window b as (partition by territory)),
z as (select territory, t, (n - first_value(n) over {W4}) / sn as zn, (price - first_value(price) over {W4}) / sp as zp, row_number() over {W4} as k from s0),
v as (select *, zn - lag(zn) over {W4} as dn, zp - lag(zp) over {W4} as dp, t - lag(t) over {W4} as dt from z),
tr as (select territory, t, k as n, sqrt(pow(dn / dt, 2) + pow(dp / dt, 2)) as speed, sqrt(dn * dn + dp * dp) as step, sqrt(zn * zn + zp * zp) as displacement from v)"""


def traj(spark, d):
    return cut(territory.trajectory(nation_month(spark, d), "territory", "t", ["n", "price"]))


@R.add(f"with {_TRAJ} select territory, n, round(speed, 6) as speed, round(step, 6) as step, round(displacement, 6) as displacement from tr")
def trajectory(spark, d):
    return traj(spark, d).select("territory", F.col("n").cast("long").alias("n"), *[r(F.col(c)).alias(c) for c in ("speed", "step", "displacement")])


@R.add(f"with {_TRAJ}, b as (select *, row_number() over (partition by territory order by n desc) as back from tr where speed is not null) select a.territory as a, c.territory as b, round(sqrt(sum(pow(a.speed - c.speed, 2))), 6) as distance from b a join b c on a.back = c.back and a.territory < c.territory and a.back <= 12 group by 1, 2")
def trajectory_compare(spark, d):
    return territory.speed_distances(traj(spark, d), "territory", 12).withColumn("distance", r(F.col("distance")))


@R.add()
def trajectory_cluster(spark, d):
    return territory.clusters(territory.path_summary(traj(spark, d), "territory"), "territory")


def _watch_sql(c: str) -> str:
    return f"""{c}_p as (select territory, quantile_cont({c}, 0.5) as m, count({c}) as k from al where n < last and {c} is not null group by 1), {c}_d as (select territory, quantile_cont(abs({c} - m), 0.5) as mad from al join {c}_p using (territory) where n < last and {c} is not null group by 1),
{c}_z as (select territory, coalesce(k >= 2, false) as ready, case when k >= 2 then ({c} - m) / greatest(1.4826e0 * mad, 0.1e0 * abs(m), 0.25e0) else 0 end as z from al left join {c}_p using (territory) left join {c}_d using (territory) where n = last),
{c}_l as (select territory, z, case when not ready then 'BASELINE_BUILDING' when z >= 3.5 then 'HIGH' when z >= 2 then 'ELEVATED' else 'NORMAL' end as level from {c}_z)"""


@R.add(f"""with {_TRAJ}, used as (select *, k <= least(4, count(*) over (partition by territory) - 1) as u from z), mid as (select territory, quantile_cont(zn, 0.5) filter (where u) as mn, quantile_cont(zp, 0.5) filter (where u) as mp from used group by 1),
wide as (select territory, greatest(1.4826e0 * quantile_cont(abs(zn - mn), 0.5) filter (where u), 0.25e0) as rn, greatest(1.4826e0 * quantile_cont(abs(zp - mp), 0.5) filter (where u), 0.25e0) as rp from used join mid using (territory) group by 1),
al as (select tr.territory, tr.n, tr.speed, sqrt(pow((zn - mn) / rn, 2) + pow((zp - mp) / rp, 2)) as departure, max(tr.n) over (partition by tr.territory) as last from tr join used on used.territory = tr.territory and used.k = tr.n join mid on mid.territory = tr.territory join wide on wide.territory = tr.territory),
{_watch_sql('departure')}, {_watch_sql('speed')}, sp as (select territory, speed, quantile_cont(speed, 0.5) over (partition by territory) as m, count(*) over (partition by territory) as k from tr where speed is not null),
sd as (select territory, any_value(m) + 3.5e0 * greatest(1.4826e0 * quantile_cont(abs(speed - m), 0.5), 1e-9) as edge from sp where k >= 3 group by 1), ch as (select distinct territory, true as c from sp join sd using (territory) where speed > edge)
select d.territory, round(d.z, 6) as departure_z, d.level as departure_level, round(s.z, 6) as speed_z, s.level as speed_level, case when d.level = 'HIGH' and s.level = 'HIGH' then 'HIGH' when d.level in ('HIGH', 'ELEVATED') or s.level in ('HIGH', 'ELEVATED') or c then 'ELEVATED' else 'NORMAL' end as status
from departure_l d join speed_l s using (territory) left join ch using (territory)""")
def trajectory_watch(spark, d):
    out = territory.watch(traj(spark, d), "territory")
    return out.withColumns({c: r(F.col(c)) for c in ("departure_z", "speed_z")})


@R.add("""with c as (select o_custkey as territory, list(distinct lower(o_orderpriority)) as u, max(o_orderpriority) as a, min(o_orderpriority) as b, any_value(case when o_custkey % 3 = 0 then null else min_p end) as c from (select *, min(o_orderpriority) over (partition by o_custkey, o_orderstatus) as min_p from orders) group by 1)
select territory, case when a = b then 0e0 else 1e0 end as score, case when a = b then 'low' else 'high' end as band from c""")
def land_use_divergence(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("territory")).agg(F.max("o_orderpriority").alias("a"), F.min("o_orderpriority").alias("b"))
    return o.select("territory", territory.divergence([F.col("a"), F.col("b"), F.lit(None).cast("string"), F.lit(" ")]).alias("x")).select("territory", "x.score", "x.band")


@R.add(f"""with {_NM}, p as (select *, count(*) over w as k, quantile_cont(n, 0.5) over w as mn, list(n) over w as pn, quantile_cont(price, 0.5) over w as mp, list(price) over w as pp from sr window w as (partition by territory order by t rows between 8 preceding and 1 preceding)),
q as (select *, abs(n - mn) / greatest(1.4826e0 * (select quantile_cont(abs(x - mn), 0.5) from (select unnest(pn) as x)), 0.1e0 * abs(mn), 1) as dn, abs(price - mp) / greatest(1.4826e0 * (select quantile_cont(abs(x - mp), 0.5) from (select unnest(pp) as x)), 0.1e0 * abs(mp), 0.05e0) as dp from p)
select territory, round(t, 6) as t, case when k >= 3 then round((least(dn / 5, 1) + least(dp / 5, 1)) / 2, 6) end as change_score,
 case when k < 3 then 'baseline_building' when greatest(dn, dp) >= 5 then 'critical_change' when greatest(dn, dp) >= 3.5 then 'changed' else 'stable' end as change_status from q""")
def monitoring_change(spark, d):
    out = territory.monitoring_change(nation_month(spark, d), "territory", "t", {"n": 1.0, "price": 0.05})
    return out.select("territory", r(F.col("t")).alias("t"), r(F.col("change_score")).alias("change_score"), "change_status")


_RULES = [(1, "n", ">=", 12.0, "medium", True), (2, "n", "<", 4.0, "info", True), (3, "price", ">", 250_000.0, "critical", True), (4, "price", "<=", 1.0, "high", False)]


def _matches(spark, d, last: int):
    rules = spark.createDataFrame(_RULES, "rule_id int, metric string, operator string, threshold double, severity string, enabled boolean")
    s = nation_month(spark, d)
    now = s.withColumn("k", F.row_number().over(Window.partitionBy("territory").orderBy(F.desc("t")))).where(F.col("k") == last)
    flat = now.select(F.col("territory").cast("string").alias("key"), F.inline(F.array(F.struct(F.lit("n").alias("metric"), F.col("n").alias("value")), F.struct(F.lit("price").alias("metric"), F.col("price").alias("value")))))
    return territory.rule_matches(flat, rules, "key"), flat.select("key")


@R.add(f"""with {_NM}, k as (select *, row_number() over (partition by territory order by t desc) as k from sr), m as (select k, territory::varchar as key, 1 as rule_id, 'medium' as sev from k where n >= 12 union all select k, territory::varchar, 2, 'info' from k where n < 4 union all select k, territory::varchar, 3, 'critical' from k where price > 250000),
a as (select * from m where k = 2), b as (select * from m where k = 1), e as (select territory::varchar as key from k where k = 1)
select coalesce(a.key, b.key) || ':' || coalesce(a.rule_id, b.rule_id) as fingerprint, coalesce(a.sev, b.sev) as severity, case when a.key is null or b.key is not null then 'open' when e.key is not null then 'resolved' else 'open' end as status, ((a.key is not null)::int + (b.key is not null)::int)::int as occurrences
from a full join b on a.key = b.key and a.rule_id = b.rule_id left join e on e.key = a.key""")
def alert_incidents(spark, d):
    """Two runs of the incident state: the last but one opens, the last repeats, resolves or opens."""
    empty = spark.createDataFrame([], "fingerprint string, key string, rule_id int, severity string, status string, occurrences int, run string")
    (m1, e1), (m2, e2) = _matches(spark, d, 2), _matches(spark, d, 1)
    first = territory.merge_incidents(empty, m1, e1, F.lit("run1"))
    return territory.merge_incidents(first, m2, e2, F.lit("run2")).select("fingerprint", "severity", "status", "occurrences")


@R.add("""select object_key, max(version)::bigint as version, count(distinct version) as versions from (select nullif(regexp_replace(lower(object_key), '^[\\s-]+|[\\s-]+$|-', '', 'g'), '') as object_key, version from territorial_objects where try_cast(created_at as timestamptz) is not null) group by 1""")
def object_versions_count(spark, d):
    raw = table(spark, d, "territorial_objects")
    ok = raw.where(instant_us(F.col("created_at")).isNotNull()).select(object_key(F.col("object_key")).alias("object_key"), "version")
    return ok.groupBy("object_key").agg(F.max("version").cast("long").alias("version"), F.count_distinct("version").alias("versions"))


@R.add(f"""with {PERIODS_SQL}, cut as (select *, floor(start_us / (30 * 86400e6)) as seg from instants),
b as (select *, row_number() over w as k, lag(name) over w as bn, lag(object_type) over w as bt, lag(status) over w as bs from cut window w as (partition by key, seg order by start_us))
select key, seg::int as seg, start_us, version::bigint as version, case when (k - 1) % 32 = 0 then 'full' else 'patch' end as kind from b where (k - 1) % 32 = 0 or name is distinct from bn or object_type is distinct from bt or status is distinct from bs""")
def attribute_store(spark, d):
    """The checkpoint and patch rows of the object log."""
    return encode(object_versions(table(spark, d, "territorial_objects"))).select("key", "seg", "start_us", "version", "kind")


@R.add(f"""with {_NM}, p as (select *, count(*) over w as k, avg(n) over w as mn, list(n) over w as pn from sr window w as (partition by territory order by t rows between 10 preceding and 1 preceding)),
q as (select *, abs(n - mn) / greatest((select avg(abs(x - mn)) from (select unnest(pn) as x)), 0.1e0 * abs(mn), 1e-6) as z from p)
select territory, round(t, 6) as t, case when k >= 3 and z >= 3.5 then 1 else 0 end as signals, case when k < 3 then 'baseline_building' when z >= 3.5 then 'drift' else 'stable' end as drift_status from q""")
def drift_signature(spark, d):
    return territory.drift(nation_month(spark, d), "territory", "t", ["n"]).select("territory", r(F.col("t")).alias("t"), "signals", "drift_status")


@R.add("""with s as (select _source_file as source, count_if(outlier_level = '99') as critical_99, avg(case when not isnan(outlier_score) then outlier_score end) as mean_spatial, avg(case when isfinite(FRP) then least(FRP, 40) / 40 end) as mean_temporal from fire_points group by 1)
select source, 'critical' as severity, 'critical_concentration' as type, critical_99::double as value from s where critical_99 >= 1 union all select source, 'high', 'spatial_signal', round(mean_spatial, 6) from s where mean_spatial >= 0.75e0 union all select source, 'high', 'temporal_signal', round(mean_temporal, 6) from s where mean_temporal >= 0.75e0""")
def findings(spark, d):
    """Findings over the sources of the fire points; two of their columns stand for the mean scores."""
    t = table(spark, d, "fire_points")
    score, frp = F.when(~F.isnan("outlier_score"), F.col("outlier_score")), F.when(~F.isnan("FRP") & (F.abs("FRP") != float("inf")), F.least("FRP", F.lit(40.0)) / 40)
    s = t.groupBy(F.col("_source_file").alias("source")).agg(F.count_if(F.col("outlier_level") == "99").alias("critical_99"), F.avg(score).alias("mean_spatial"), F.avg(frp).alias("mean_temporal"))
    return territory.findings(s, "source").drop("measure").withColumn("value", r(F.col("value")))


@R.add("select n_nationkey, n_name, count(s_suppkey) as object_count from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 0 group by 1, 2")
def watchlist_counts(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0")
    return table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("object_count"))


@R.add("""with s as (select l_orderkey, l_linenumber, 0.4e0 * least(greatest(l_discount * 10, 0), 1) + 0.3e0 * least(greatest(l_tax * 12, 0), 1) + 0.2e0 * least(greatest(l_quantity / 50, 0), 1) + 0.1e0 * least(greatest(l_extendedprice / 100000, 0), 1) as s from lineitem)
select l_orderkey, l_linenumber, round(s, 9) as score, case when s >= 0.7 then 'high' when s >= 0.4 then 'medium' else 'low' end as band from s""")
def risk_score(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 12).alias("b"), (F.col("l_quantity") / 50).alias("c"), (F.col("l_extendedprice") / 100000).alias("e"))
    x = t.select("l_orderkey", "l_linenumber", territory.risk({"a": 0.4, "b": 0.3, "c": 0.2, "e": 0.1}).alias("x"))
    return x.select("l_orderkey", "l_linenumber", r(F.col("x.score"), 9).alias("score"), "x.band")


@R.add(f"with {_NM}, k as (select territory, n, row_number() over {W4} - 1 as i from sr) select territory, round(regr_intercept(n, i) + regr_slope(n, i) * count(*), 6) as next_value, count(*) as n from k group by 1")
def linear_forecast(spark, d):
    return temporal.trend(nation_month(spark, d), ["territory"], ["t"], "n").select("territory", r(F.col("next_value")).alias("next_value"), F.col("n"))


@R.add(f"""with {_NM}, p as (select territory, t, price, row_number() over (partition by territory order by t desc) as k from sr), h as (select territory, avg(price) as m, stddev_pop(price) as s from p where k > 1 group by 1)
select p.territory, round(m, 6) as baseline, round(price - m, 6) as delta, round((price - m) / greatest(s, 1e-12), 6) as z from p join h using (territory) where k = 1""")
def core_baseline(spark, d):
    p = nation_month(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("territory").orderBy(F.desc("t"))))
    g = p.groupBy("territory").agg(F.avg(F.when(F.col("k") > 1, F.col("price"))).alias("m"), F.stddev_pop(F.when(F.col("k") > 1, F.col("price"))).alias("s"), F.max(F.when(F.col("k") == 1, F.col("price"))).alias("now"))
    return g.where("m is not null").select("territory", r(F.col("m")).alias("baseline"), r(F.col("now") - F.col("m")).alias("delta"), r((F.col("now") - F.col("m")) / F.greatest("s", F.lit(1e-12))).alias("z"))


_PIX = "px as (select l_orderkey, l_linenumber, (l_orderkey % 65536)::int as qa, l_quantity / 50 as red, l_extendedprice / 100000 as nir, l_discount * 5 as green, l_tax * 5 as swir16, (l_linenumber::double / 8) as swir22 from lineitem)"


def pixels(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_orderkey") % 65536).cast("int").alias("qa"), (c("l_quantity") / 50).alias("red"), (c("l_extendedprice") / 100000).alias("nir"), (c("l_discount") * 5).alias("green"), (c("l_tax") * 5).alias("swir16"), (c("l_linenumber").cast("double") / 8).alias("swir22"))


def _nd(a: str, b: str) -> str:
    return f"round(case when abs({a} + {b}) > 1e-8 then ({a} - {b}) / ({a} + {b}) end, 6)"


@R.add(f"with {_PIX} select l_orderkey, l_linenumber, {_nd('nir', 'red')} as ndvi, {_nd('nir', 'swir16')} as ndmi, {_nd('nir', 'swir22')} as nbr, {_nd('green', 'nir')} as ndwi from px")
def indices(spark, d):
    return pixels(spark, d).select("l_orderkey", "l_linenumber", *[r(raster.index(n)).alias(n) for n in raster.INDICES])


@R.add(f"with {_PIX} select (qa & 63) = 0 as landsat_clear, (qa % 12) not in (0, 1, 3, 8, 9, 10, 11) as sentinel_clear, count(*) as n, round(avg(qa * 2.75e-5 - 0.2e0), 6) as mean_red, round(avg(qa * 0.00341802e0 + (149e0 - 273.15e0)), 4) as mean_thermal from px group by 1, 2")
def cloud_mask(spark, d):
    p = pixels(spark, d)
    g = p.groupBy(raster.clear("landsat", p.qa).alias("landsat_clear"), raster.clear("sentinel2", p.qa % 12).alias("sentinel_clear"))
    return g.agg(F.count("*").alias("n"), r(F.avg(raster.scale_band("landsat", "red", p.qa))).alias("mean_red"), r(F.avg(raster.scale_band("landsat", "thermal", p.qa)), 4).alias("mean_thermal"))


_HAVS = "2e0 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@R.add(f"""with w as ({WGS_SQL}), s as (select s_suppkey as id, -75 + (s_suppkey * 53 % 997) / 1e3 as lon, 6 + (s_suppkey * 71 % 991) / 1e3 as lat from supplier)
select a.c_custkey as left_id, b.id as right_id, round({_HAVS}, 3) as distance_m from w a, s b qualify rank() over (partition by a.c_custkey order by {_HAVS}) = 1""")
def nearest_join(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("id"), (F.lit(-75) + (k * 53 % 997) / F.lit(1e3)).alias("lon"), (F.lit(6) + (k * 71 % 991) / F.lit(1e3)).alias("lat"))
    return geometry.nearest_join(wgs(spark, d).withColumnRenamed("c_custkey", "id"), s).withColumn("distance_m", r(F.col("distance_m"), 3))


@R.add(GENERAL["p3_found"].rsplit("select 'near'", 1)[0] + "select row_id as key_a, id as key_b from held")
def within_join(spark, d):
    """Points within the layers, by the operator's path for region tables of any size."""
    layers = table(spark, d, "layers").select(F.col("id").alias("region_id"), F.col("geometry_json").alias("geojson"))
    return nearby.containing(fire_positions(spark, d), layers, max_regions=0)


_ARC = f"{500.0 / EARTH_M!r}"


@R.add(f"""with w as ({WGS_SQL}), c as (select c_custkey, k, radians(lat) as p, radians(lon) as l, (k % 64) * {2 * math.pi / 64!r} as t from w, range(65) g(k)),
y as (select *, asin(sin(p) * cos({_ARC}) + cos(p) * sin({_ARC}) * cos(t)) as y from c)
select c_custkey, 'POLYGON ((' || string_agg(printf('%.6f %.6f', degrees(l + atan2(sin(t) * sin({_ARC}) * cos(p), cos({_ARC}) - sin(p) * sin(y))), degrees(y)), ', ' order by k) || '))' as wkt from y group by 1""")
def metric_buffer(spark, d):
    w = wgs(spark, d)
    return w.select("c_custkey", geometry.point_buffer(w.lat, w.lon, 500.0).alias("wkt"))


_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_RADIUS, _ECC = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64), 2 * _N**0.5 / (1 + _N)
_EAST = " + ".join(["eta", *(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))])
_NORTH = " + ".join(["xi", *(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))])


@R.add(f"""with w as ({WGS_SQL}), t as (select c_custkey, lon, radians(lon + 75) as dl, sinh(atanh(sin(radians(lat))) - {_ECC!r} * atanh({_ECC!r} * sin(radians(lat)))) as t from w),
k as (select c_custkey, lon, atan2(t, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + t * t)) as eta from t)
select c_custkey, (floor((lon + 180) / 6) + 1)::int as zone, round(({_EAST}) * {0.9996 * _RADIUS!r} + 500000, 4) as easting, round(({_NORTH}) * {0.9996 * _RADIUS!r}, 4) as northing from k""")
def utm_points(spark, d):
    w = wgs(spark, d)
    x, y = geometry.utm(w.lat, w.lon, 18)
    return w.select("c_custkey", geometry.utm_zone(w.lon).alias("zone"), r(x, 4).alias("easting"), r(y, 4).alias("northing"))


_CONTRACT = (
    ("ACQ_DATE", "timestamp", "structural", 0.9, "alias"), ("ACQ_DATE", "date", "structural", 1.0, "alias"), ("row_id", "id", "structural", 0.9, "alias"), ("lat", "latitude", "structural", 1.0, "alias"), ("lon", "longitude", "structural", 1.0, "alias"),
    ("ACQ_TIME", "time", "structural", 1.0, "alias"), ("FRP", "FRP", "measure", 1.0, "domain_pack"), ("BRIGHTNESS", "BRIGHTNESS", "measure", 1.0, "domain_pack"),
)


@R.add("select * from (values " + ", ".join(map(str, _CONTRACT)) + ") t(\"column\", semantic, role, confidence, source)")
def semantic_contract(spark, d):
    """Roles and named measures of the scored layer's columns."""
    made = semantics.contract(table(spark, d, "fire_points"), {"id": "fire", "variables": ["FRP", "BRIGHTNESS"], "aliases": [["FRP", "fire_radiative_power"]]})
    return made.where("source <> 'generic_numeric'")


@R.add("""with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_extendedprice) as n from lineitem), g as (select l_orderkey as id, count(*) as n, regr_slope(l_quantity, n - 1) as b, regr_intercept(l_quantity, n - 1) as a, avg(l_quantity) as m from l group by 1)
select id, round(case when n = 1 then m else a + b * n end, 6) as next_value, round(case when n = 1 then 0 else b end, 6) as slope, n from g""")
def order_forecast(spark, d):
    out = core.forecast(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_quantity", "l_extendedprice"], "l_quantity")
    return out.select(F.col("l_orderkey").alias("id"), r(F.col("next_value")).alias("next_value"), r(F.col("slope")).alias("slope"), "n")


@R.add(f"""with w as ({WGS_SQL}), e as (select a.c_custkey as x, b.c_custkey as y, {_HAVS} / 1000 as km from w a join w b on a.c_custkey <> b.c_custkey and abs(a.lat - b.lat) < 0.05 and abs(a.lon - b.lon) < 0.05 where {_HAVS} <= 4000),
q as (select x as id, min(km) as nearest_km, count(*) as nearby, sum(1 / (1 + km)) as w from e group by 1)
select c_custkey as id, round(nearest_km, 6) as nearest_km, coalesce(nearby, 0) as nearby, round(least(1, coalesce(nearby, 0) / 12e0), 6) as density, round(least(1, coalesce(q.w, 0) / 6e0), 6) as connectivity from w left join q on q.id = c_custkey""")
def property_intelligence(spark, d):
    n = wgs(spark, d).select(F.col("c_custkey").alias("id"), "lat", "lon")
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("n"), F.col("o_totalprice").alias("value"))
    out = core.property_intelligence(n, nearby.near_pairs(n, 4_000.0), h)
    return out.select("id", *[r(F.col(c)).alias(c) for c in ("nearest_km", "density", "connectivity")], "nearby")


_LEFT_SHAPES = "ls as (select c_custkey as id, c_custkey % 3 as kind, c_custkey * 37 % 101 as x0, c_custkey * 91 % 103 as y0, c_custkey * 37 % 101 + case when c_custkey % 3 = 2 then 0 else 1 + c_custkey % 4 end as x1, c_custkey * 91 % 103 + case when c_custkey % 3 = 0 then 1 + c_custkey % 5 else 0 end as y1 from customer)"
_RIGHT_SHAPES = "rs as (select s_suppkey as id, s_suppkey * 53 % 97 as x0, s_suppkey * 71 % 89 as y0, s_suppkey * 53 % 97 + 1 + s_suppkey % 7 as x1, s_suppkey * 71 % 89 + 1 + s_suppkey % 5 as y1 from supplier)"
# rectangles (kind 0), level lines (1) and points (2) on a grid, against rectangles
_RELATED = f"""{_LEFT_SHAPES}, {_RIGHT_SHAPES}, met as (select l.id as left_id, r.id as right_id, kind, (l.x0 < r.x1 and l.x1 > r.x0 and l.y0 < r.y1 and l.y1 > r.y0) as ii,
 (l.x0 >= r.x0 and l.x1 <= r.x1 and l.y0 >= r.y0 and l.y1 <= r.y1) as cov, (kind = 0 and l.x0 <= r.x0 and l.x1 >= r.x1 and l.y0 <= r.y0 and l.y1 >= r.y1) as cvs from ls l join rs r on l.x0 <= r.x1 and l.x1 >= r.x0 and l.y0 <= r.y1 and l.y1 >= r.y0)"""


def _boxes(df, x0, y0, x1, y1, kind):
    text = F.when(kind == 0, F.format_string("POLYGON ((%d %d, %d %d, %d %d, %d %d, %d %d))", x0, y0, x1, y0, x1, y1, x0, y1, x0, y0))
    text = text.when(kind == 1, F.format_string("LINESTRING (%d %d, %d %d)", x0, y0, x1, y1)).otherwise(F.format_string('{"type": "Point", "coordinates": [%d, %d]}', x0, y0))
    return df.select("id", text.alias("geometry"))


def grid_shapes(spark, d):
    c, s = table(spark, d, "customer").withColumnRenamed("c_custkey", "id"), table(spark, d, "supplier").withColumnRenamed("s_suppkey", "id")
    k = F.col("id")
    x, y, u, v = k * 37 % 101, k * 91 % 103, k * 53 % 97, k * 71 % 89
    left = _boxes(c, x, y, x + F.when(k % 3 == 2, 0).otherwise(1 + k % 4), y + F.when(k % 3 == 0, 1 + k % 5).otherwise(0), k % 3)
    return left, _boxes(s, u, v, u + 1 + k % 7, v + 1 + k % 5, F.lit(0))


@R.add(f"""with {_RELATED} select left_id, right_id, p as predicate from met, (values ('intersects'), ('within'), ('contains'), ('covers'), ('covered_by'), ('crosses'), ('touches'), ('overlaps')) t(p)
where case p when 'intersects' then true when 'within' then cov and ii when 'contains' then cvs when 'covers' then cvs when 'covered_by' then cov when 'crosses' then kind = 1 and ii and not cov when 'touches' then not ii else kind = 0 and ii and not cov and not cvs end""")
def spatial_predicates(spark, d):
    """Every relation between rectangles, lines and points of one table and rectangles of another."""
    told = planes.relations(*grid_shapes(spark, d))
    names = F.array_compact(F.array(*[F.when(F.col(p), F.lit(p)) for p in RELATIONS]))
    return told.select("left_id", "right_id", F.explode(names).alias("predicate"))


@R.add(f"with {_RELATED} select ls.id as left_id, coalesce(met.right_id, -1) as right_id from ls left join met on met.left_id = ls.id and cov and ii")
def spatial_left_join(spark, d):
    return planes.spatial_join(*grid_shapes(spark, d), predicate="within", how="left").fillna(-1, ["right_id"])


@R.add(f"""with {_LEFT_SHAPES}, {_RIGHT_SHAPES} select l.id as left_id, r.id as right_id, ((least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)))::double as area
from ls l join rs r on l.x0 < r.x1 and l.x1 > r.x0 and l.y0 < r.y1 and l.y1 > r.y0 where kind = 0""")
def overlay_intersection(spark, d):
    left, right = grid_shapes(spark, d)
    return planes.overlay(left, right).select("left_id", "right_id", r(F.col("area")).alias("area"))


_STRIP = (-62.0, -48.0)


@R.add(f"""with parts as (select id, unnest(case when geometry_json->>'type' = 'MultiPolygon' then from_json(geometry_json->'coordinates', '["JSON"]') else [geometry_json->'coordinates'] end) as poly from layers),
rings as (select id, row_number() over () as part, poly from parts where json_array_length(poly) > 0), ring as (select id, part, unnest(from_json(poly, '[[["DOUBLE"]]]')) as ring, generate_subscripts(from_json(poly, '[[["DOUBLE"]]]'), 1) as nth from rings),
edge as (select id, part, nth, ring[k][1] as ax, ring[k][2] as ay, ring[k % len(ring) + 1][1] as ex, ring[k % len(ring) + 1][2] as ey from (select *, unnest(range(1, len(ring) + 1)) as k from ring)),
cut as (select *, least(greatest(ax, {_STRIP[0]}), {_STRIP[1]}) as u, least(greatest(ex, {_STRIP[0]}), {_STRIP[1]}) as v from edge),
piece as (select id, part, nth, abs(sum(case when ax = ex then 0 else (v - u) * (ay + (u - ax) * (ey - ay) / (ex - ax) + ay + (v - ax) * (ey - ay) / (ex - ax)) / 2 end)) as a from cut group by all)
select id as left_id, round(sum(case when nth = 1 then a else -a end), 6) as area from piece group by 1 having sum(case when nth = 1 then a else -a end) > 1e-9""")
def overlay_strip(spark, d):
    """Area of each layer within a strip of longitudes, holes taken off."""
    layers = table(spark, d, "layers").select("id", F.col("geometry_json").alias("geometry"))
    a, b = _STRIP
    strip = spark.createDataFrame([(1, f"POLYGON (({a} -89, {b} -89, {b} 89, {a} 89, {a} -89))")], "id long, geometry string")
    return planes.overlay(layers, strip).select("left_id", r(F.col("area")).alias("area"))


@R.add(f"""with {_LEFT_SHAPES}, {_RIGHT_SHAPES}, t as (select distinct l.id, a, b from ls l left join rs r on l.x0 < r.x1 and l.x1 > r.x0 and l.y0 < r.y1 and l.y1 > r.y0, lateral (select unnest(range(l.x0, l.x1)) as a) x, lateral (select unnest(range(l.y0, l.y1)) as b) y
 where kind = 0 and not exists (select 1 from rs q where q.x0 <= a and q.x1 > a and q.y0 <= b and q.y1 > b)) select id as left_id, count(*)::double as area from t group by 1""")
def overlay_difference(spark, d):
    """What is left of each rectangle without those of the other table."""
    left, right = grid_shapes(spark, d)
    return planes.overlay(left.where(F.col("geometry").startswith("POLYGON")), right, "difference").select("left_id", r(F.col("area")).alias("area"))


@R.add(f"with {_LEFT_SHAPES} select id, round(case kind when 0 then (x1 - x0) * (y1 - y0) + 2 * 0.75e0 * (x1 - x0 + y1 - y0) else 2 * 0.75e0 * (x1 - x0) end + 16 * 0.75e0 * 0.75e0 * sin(2 * pi() / 32), 6) as area from ls")
def corridor_buffers(spark, d):
    """Areas of the buffers of rectangles, lines and points, with circles of 32 corners."""
    left, _ = grid_shapes(spark, d)
    return planes.buffers(left, 0.75).select("id", r(F.col("area")).alias("area"))


@R.add("select c_custkey as id, round((1 + c_custkey % 5) * (1 + c_custkey % 3) / case when c_custkey % 2 = 0 then 2e0 else 1e0 end, 6) as area, c_custkey % 2 <> 0 as was_valid from customer")
def repaired_rings(spark, d):
    """Rectangles, every other one with two corners exchanged, so that its ring crosses itself."""
    k = F.col("c_custkey")
    w, h = 1 + k % 5, 1 + k % 3
    sound, crossed = F.format_string("POLYGON ((0 0, %d 0, %d %d, 0 %d, 0 0))", w, w, h, h), F.format_string("POLYGON ((0 0, %d %d, %d 0, 0 %d, 0 0))", w, h, w, h)
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 2 == 0, crossed).otherwise(sound).alias("geometry"))
    return planes.repaired(rows).select("id", r(F.col("area")).alias("area"), "was_valid")


_OKEY = r"nullif(regexp_replace(lower(object_key), '^[\s-]+|[\s-]+$|-', '', 'g'), '')"


def _incidents(spark, d):
    raw = table(spark, d, "alert_incidents")
    return raw.select(F.col("id").alias("incident_id"), object_key(F.col("object_key")).alias("object_key"), F.struct("recorded_at", "occurrences", "status").alias("rec"), "severity", "status", "occurrences")


@R.add(f"""with i as (select id as incident_id, {_OKEY} as object_key, severity, status from alert_incidents qualify row_number() over (partition by id order by recorded_at desc, occurrences desc, status desc) = 1),
m as (select incident_id, owner, priority from incident_management where incident_id is not null qualify row_number() over (partition by incident_id order by recorded_at desc, updated_at desc, priority desc, owner desc nulls last) = 1),
n as (select incident_id, count(distinct id) as n_notes from incident_notes where incident_id is not null group by 1),
o as (select {_OKEY} as object_key, max(version) as version from territorial_objects where version is not null group by 1)
select incident_id, object_key, severity, status, coalesce(priority, '-') as priority, coalesce(n_notes, 0) as n_notes, coalesce(o.version, -1) as version from i left join m using (incident_id) left join n using (incident_id) left join o using (object_key)""")
def incident_cases(spark, d):
    m = table(spark, d, "incident_management").select("incident_id", F.struct("recorded_at", "updated_at", "priority", "owner").alias("rec"), "owner", "priority")
    o = table(spark, d, "territorial_objects").where("version is not null").select(object_key(F.col("object_key")).alias("object_key"), "version", "name", "status")
    out = territory.cases(_incidents(spark, d), m, table(spark, d, "incident_notes"), o)
    return out.select("incident_id", "object_key", "severity", "status", F.coalesce("priority", F.lit("-")).alias("priority"), "n_notes", F.coalesce("version", F.lit(-1)).alias("version"))


@R.add(f"""with m as (select distinct {_OKEY} as object_key, id, epoch_us(try_cast(created_at as timestamptz)) as at_us, status from territorial_monitoring), a as (select {_OKEY} as object_key, count(distinct id) as alerts from territorial_alerts group by 1)
select m.object_key, count(*) as runs, max(at_us) as last_us, arg_max(status, struct_pack(a := at_us, b := id)) as last_status, coalesce(any_value(alerts), 0) as alerts, case when count(*) >= 3 then 'ready' else 'building' end as baseline_state
from m left join a using (object_key) where m.object_key is not null group by 1""")
def monitoring_dashboard(spark, d):
    rows = lambda name, *more: table(spark, d, name).select(object_key(F.col("object_key")).alias("object_key"), "id", instant_us(F.col("created_at")).alias("at_us"), *more)
    return territory.dashboard(rows("territorial_monitoring", "status"), rows("territorial_alerts"))


@R.add("""with i as (select * from alert_incidents qualify row_number() over (partition by id order by recorded_at desc, occurrences desc, status desc) = 1)
select status, severity, count(*) as incidents, sum(occurrences)::bigint as occurrences from i group by 1, 2""")
def operations_rollup(spark, d):
    return territory.operations(_incidents(spark, d))


@R.add("""with s as (select _api_source as product, count_if(outlier_level = '99') as critical_99, count_if(consensus_methods >= 3) as hotspots, 0 as clusters, case when count(*) > 3000 then count_if(FRP > 40 and not isnan(FRP)) end as change_points from fire_points group by 1)
select product, 'critical' as severity, 'statistical' as type, critical_99::double as value from s where critical_99 >= 1 union all select product, 'high', 'spatial', hotspots from s where hotspots >= 1 union all select product, 'elevated', 'temporal', change_points from s where change_points >= 1""")
def analysis_findings(spark, d):
    """Findings over a summary of the products; some of its measures are stand-ins, one is always 0 and one may be NULL."""
    t = table(spark, d, "fire_points")
    s = t.groupBy(F.col("_api_source").alias("product")).agg(F.count_if(F.col("outlier_level") == "99").alias("critical_99"), F.count_if(F.col("consensus_methods") >= 3).alias("hotspots"), F.lit(0).alias("clusters"), F.when(F.count("*") > 3000, F.count_if((F.col("FRP") > 40) & ~F.isnan("FRP"))).alias("change_points"))
    return territory.findings(s, "product", territory.ANALYSIS_RULES).drop("measure")


@R.add("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O') as admitted from customer")
def admitted_requests(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return keys.admitted(c, o, ["c_custkey"], F.col("o_orderstatus") == "O")


@R.add("select c_custkey, 'none' as orders from customer where c_custkey not in (select o_custkey from orders) union all select c_custkey, 'some' from customer where c_custkey in (select o_custkey from orders)")
def key_sets(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return keys.missing(c, o, ["c_custkey"]).withColumn("orders", F.lit("none")).unionByName(keys.common(c, o, ["c_custkey"]).withColumn("orders", F.lit("some")))


@R.add("""with p as (select distinct lon, lat from fire_points where lon between -180 and 180 and lat between -90 and 90)
select round(min(lon), 6) as west, round(min(lat), 6) as south, round(max(lon), 6) as east, round(max(lat), 6) as north, round(avg(lon), 6) as mid_lon, round(avg(lat), 6) as mid_lat, true as weather, false as fires,
 (select strftime(min(ACQ_DATE), '%Y-%m-%d') from fire_points where lon between -180 and 180 and lat between -90 and 90) as first_day, (select strftime(max(ACQ_DATE), '%Y-%m-%d') from fire_points where lon between -180 and 180 and lat between -90 and 90) as last_day from p""")
def enrichment_plan(spark, d):
    p = enrichment.plan(table(spark, d, "fire_points"), "ACQ_DATE", weather=True, fires=True, fire_key=True)
    return p.select(*[r(F.col(c)).alias(c) for c in ("west", "south", "east", "north", "mid_lon", "mid_lat")], "weather", "fires", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_day", "last_day")])


@R.add("select status, count(*) as n from (select * from territorial_monitoring order by id desc limit 100) group by 1")
def job_health(spark, d):
    return state.health(table(spark, d, "territorial_monitoring"), "id")


@R.add("""with d as (select user_id, event_id, ts, abs(value - coalesce(lag(value) over w, value)) as diff from events window w as (partition by user_id order by ts, event_id)),
m as (select user_id, quantile_cont(diff, 0.5) as m from d group by 1), s as (select user_id, quantile_cont(abs(diff - m), 0.5) + 1e-12 as s from d join m using (user_id) group by 1),
c as (select user_id, event_id, ts, (diff - m) / (1.4826e0 * s) as score from d join m using (user_id) join s using (user_id))
select user_id, event_id, round(score, 6) as change_score from c where score > 3.5 qualify row_number() over (partition by user_id order by ts, event_id) <= 3""")
def first_change_points(spark, d):
    """The first three change points of each user."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    found = temporal.change_points(e, ["user_id"], ["ts", "event_id"], "value")
    return temporal.first_changes(found, ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", r(F.col("change_score")).alias("change_score"))


@R.add("""with p as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as v from embeddings), s as (select * from p where id % 7 = 0)
select p.id, round(arg_min(s.v, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)), 9) as v, arg_min(s.id, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) as source from p, s group by p.id""")
def score_transfer(spark, d):
    """Every vector takes the value of the nearest of those whose id is divisible by 7."""
    e = F.col("embedding")
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[e[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "v"))])
    return detect.transfer(p, p.where("id % 7 = 0"), ["x", "y"], "v").withColumn("v", r(F.col("v"), 9))


_GRID = "px as (select distinct on (row, col) l_orderkey % 90 as row, l_partkey % 110 as col, l_quantity as red, l_linenumber as qa from lineitem order by row, col, l_orderkey, l_linenumber, l_quantity)"


@R.add(f"""with {_GRID}, f as (select sqrt(80 * 100 / 500e0) as f), z as (select ceil(80 / f)::int as h, ceil(100 / f)::int as w from f), t as (select (row - 5 + 0.5e0) * (h / 80e0) as y, (col - 3 + 0.5e0) * (w / 100e0) as x, red, qa, row, col from px, z where row between 5 and 84 and col between 3 and 102)
select floor(y)::int as row, floor(x)::int as col, round(avg(red), 6) as red, arg_min(qa, struct_pack(a := round(pow(y - floor(y) - 0.5e0, 2) + pow(x - floor(x) - 0.5e0, 2), 9), b := t.row, c := t.col)) as qa, count(*) as n from t group by 1, 2""")
def raster_window(spark, d):
    """A window of a pixel table, shrunk to about 500 pixels."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 90).alias("row"), (F.col("l_partkey") % 110).alias("col"), "l_orderkey", "l_linenumber", "l_quantity")
    px = li.groupBy("row", "col").agg(F.min_by(F.struct(F.col("l_quantity").alias("red"), F.col("l_linenumber").alias("qa")), F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("p")).select("row", "col", "p.*")
    return raster.window(px, 5, 3, 80, 100, ["red"], "qa", 500).withColumn("red", r(F.col("red")))
