"""Ranks, cleaning, quality, regions, samples and time series over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.common import table
from terravane.functions.stats import finite, quantile
from terravane.operators import cleaning, ranking, regions, temporal
from terravane.queries.registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql
BOX = (-74.8, 6.1, -74.2, 6.7)
RING = [(-74.8, 6.1), (-74.2, 6.2), (-74.1, 6.8), (-74.6, 6.9), (-74.5, 6.5)]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WGS_SQL = "select c_custkey, c_nationkey, c_acctbal, -75 + (c_custkey * 37 % 1009) / 1e3 as lon, 6 + (c_custkey * 91 % 1013) / 1e3 as lat from customer"


def wgs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", (F.lit(-75) + (k * 37 % 1009) / F.lit(1e3)).alias("lon"), (F.lit(6) + (k * 91 % 1013) / F.lit(1e3)).alias("lat"))


def r(c, n: int = 6):
    return F.round(c, n)


@R.add("""with q as (select quantile_cont(l_quantity, [0.25, 0.5, 0.75]) as a, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) as b from lineitem)
select l_orderkey, l_linenumber, round((l_quantity - a[2]) / (a[3] - a[1]), 6) as quantity_scaled, round((l_extendedprice - b[2]) / (b[3] - b[1]), 6) as price_scaled from lineitem, q""")
def scale_robust(spark, d):
    out = cleaning.robust_scale(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", r(F.col("l_quantity_scaled")).alias("quantity_scaled"), r(F.col("l_extendedprice_scaled")).alias("price_scaled"))


@R.add("""select l_orderkey, l_linenumber, round((rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2e0) / count(*) over (), 9) as pct from lineitem""")
def pct_rank(spark, d):
    return ranking.percent_rank(table(spark, d, "lineitem"), "l_quantity", "pct").select("l_orderkey", "l_linenumber", r(F.col("pct"), 9).alias("pct"))


@R.add("select event_id, round((row_number() over (order by value, event_id) - 1) / (count(*) over () - 1)::double, 9) as rank01 from events")
def rank01(spark, d):
    return ranking.ordinal01(table(spark, d, "events"), "value", "event_id", "rank01").select("event_id", r(F.col("rank01"), 9).alias("rank01"))


@R.add("""with f as (select row_id, case when FRP is not null and not isnan(FRP) and not isinf(FRP) then FRP end as v from fire_points), m as (select quantile_cont(v, 0.5) as m from f)
select row_id, round(coalesce(v, m), 6) as frp from f, m""")
def impute_median(spark, d):
    return cleaning.impute_median(table(spark, d, "fire_points").select("row_id", "FRP"), ["FRP"]).select("row_id", r(F.col("FRP")).alias("frp"))


@R.add("""select row_id, _source_file from fire_points qualify row_number() over (partition by _source_file, _api_source, ACQ_DATE, ACQ_TIME order by row_id) = 1""")
def dedup_first(spark, d):
    rows = table(spark, d, "fire_points").select("row_id", "_source_file", "_api_source", "ACQ_DATE", "ACQ_TIME")
    return cleaning.first_by_key(rows, ["_source_file", "_api_source", "ACQ_DATE", "ACQ_TIME", "absent_key"], "row_id").select("row_id", "_source_file")


@R.add("""select c_custkey as key, c_name as name, c_mktsegment as segment, 'customer' as _source_file from customer union all select s_suppkey, s_name, null, 'supplier' from supplier""")
def union_sources(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return cleaning.union_sources([a, b], ["customer", "supplier"])


@R.add("""select row_id, case when isinf(FRP) or isnan(FRP) then null else FRP end as frp, case when isinf(BRIGHTNESS) or isnan(BRIGHTNESS) then null else BRIGHTNESS end as brightness from fire_points""")
def inf_to_null(spark, d):
    return cleaning.without_infinities(table(spark, d, "fire_points").select("row_id", F.col("FRP").alias("frp"), F.col("BRIGHTNESS").alias("brightness")), ["frp", "brightness"])


@R.add(f"with w as ({WGS_SQL}) select c_custkey, lon, lat from w where lon between -74.8 and -74.2 and lat between 6.1 and 6.7")
def bbox_filter(spark, d):
    w = wgs(spark, d)
    return w.where(cleaning.in_box(w.lon, w.lat, BOX)).select("c_custkey", "lon", "lat")


def _ring_sql() -> str:
    parts, edges = [], []
    for (ax, ay), (bx, by) in zip(RING, RING[1:] + RING[:1]):
        cross = f"(({bx - ax}e0) * (lat - ({ay}e0)) - ({by - ay}e0) * (lon - ({ax}e0)))"
        edges.append(f"({cross} = 0 and lon between {min(ax, bx)}e0 and {max(ax, bx)}e0 and lat between {min(ay, by)}e0 and {max(ay, by)}e0)")
        parts.append(f"case when ({ay}e0 > lat) <> ({by}e0 > lat) and ({cross} > 0) = ({str(by > ay).lower()}) then 1 else 0 end")
    return f"(({' + '.join(parts)}) % 2 = 1 or {' or '.join(edges)})"


@R.add(f"with w as ({WGS_SQL}) select c_custkey, lon, lat from w where {_ring_sql()}")
def polygon_filter(spark, d):
    w = wgs(spark, d)
    return w.where(cleaning.in_polygon(w.lon, w.lat, RING)).select("c_custkey", "lon", "lat")


@R.add("""with f as (select lon, lat, FRP, geometry from fire_points), m as (select count(*) as rows, count_if(lon is null or lat is null) as missing_positions, 0::bigint as invalid_positions,
 count_if(lon is not null and lat is not null) - count(distinct case when lon is not null and lat is not null then (lon, lat) end) as repeated_positions,
 count_if(lon is not null and lat is not null and not (lon between -180 and 180 and lat between -90 and 90)) as out_of_range,
 ((avg((lon is null)::int) > 0.5)::int + (avg((lat is null)::int) > 0.5)::int + (avg((FRP is null)::int) > 0.5)::int + (avg((geometry is null)::int) > 0.5)::int)::bigint as sparse_columns from f),
s as (select *, greatest(0, 1 - (missing_positions / rows::double * 0.25e0 + repeated_positions / rows::double * 0.15e0 + out_of_range / rows::double * 0.25e0 + sparse_columns / 4e0 * 0.10e0)) as sc from m)
select rows, missing_positions, invalid_positions, repeated_positions, out_of_range, sparse_columns, round(sc, 6) as score,
 case when sc >= 0.95 then 'excellent' when sc >= 0.85 then 'good' when sc >= 0.7 then 'warning' else 'poor' end as grade, case when out_of_range > 0 then 'blocked' when sc < 0.7 then 'warning' else 'passed' end as gate from s""")
def quality_metrics(spark, d):
    return cleaning.quality(table(spark, d, "fire_points").select("lon", "lat", "FRP", "geometry"), "lon", "lat").withColumn("score", r(F.col("score")))


def _profile_sql() -> str:
    one = "select '{0}' as \"column\", count({0}) as non_null, round(1 - count({0}) / count(*)::double, 9) as missing_ratio, count(distinct {0}) as distinct_values, round(count({1}) / nullif(count({0}), 0)::double, 9) as numeric_ratio, count({1}) >= 30 as usable_numeric from orders"
    return " union all ".join(one.format(c, f"try_cast({c} as double)" if c != "o_orderdate" else "null") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


@R.add(_profile_sql())
def column_profile(spark, d):
    p = cleaning.profile(table(spark, d, "orders"))
    return p.withColumn("missing_ratio", r(F.col("missing_ratio"), 9)).withColumn("numeric_ratio", r(F.col("numeric_ratio"), 9))


@R.add("""with n as (select c_nationkey, c_acctbal, round(c_acctbal, 0) as s from customer) select c_nationkey, count(*) as rows, count_if(c_acctbal > 8000) as critical, count_if(c_acctbal > 6000) as high,
 round(avg(c_acctbal), 6) as mean_score, round(quantile_cont(c_acctbal, 0.5), 6) as median_score, round(avg(case when c_acctbal < 0 then c_acctbal end), 6) as mean_negative from n group by 1""")
def region_summary(spark, d):
    c = F.col("c_acctbal")
    out = regions.summarize(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", {"critical": c > 8000, "high": c > 6000}, {"mean_negative": F.when(c < 0, c)})
    return out.withColumns({x: r(F.col(x)) for x in ("mean_score", "median_score", "mean_negative")})


@R.add("""with t as (select o_totalprice as v, (o_orderstatus = 'F')::int as a from orders where o_orderstatus in ('F', 'O')),
k as (select *, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2e0 as rk from t),
s as (select sum(a)::double as n1, sum(1 - a)::double as n2, sum(case when a = 1 then rk end) - sum(a) * (sum(a) + 1) / 2e0 as u from k), ties as (select sum(c * c * c - c)::double as t from (select count(*)::double as c from t group by v))
select n1, n2, round(u, 3) as u, round(1 - 2 * u / (n1 * n2), 9) as rank_biserial, round(greatest(0, abs(u - n1 * n2 / 2) - 0.5e0) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties.t / ((n1 + n2) * (n1 + n2 - 1)))), 6) as z from s, ties""")
def region_compare_mw(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    out = regions.mann_whitney(o, "o_totalprice", F.col("o_orderstatus") == "F")
    return out.select("n1", "n2", r(F.col("u"), 3).alias("u"), r(F.col("rank_biserial"), 9).alias("rank_biserial"), r(F.col("z")).alias("z"))


@R.add("""with t as (select o_totalprice as v, (o_orderstatus = 'F')::int as a from orders where o_orderstatus in ('F', 'O')), g as (select v, sum(a) as a, sum(1 - a) as b from t group by v),
c as (select sum(a) over (order by v) / (sum(a) over ())::double as fa, sum(b) over (order by v) / (sum(b) over ())::double as fb, sum(a) over () as n1, sum(b) over () as n2 from g)
select round(max(abs(fa - fb)), 9) as ks_statistic, max(n1)::bigint as n1, max(n2)::bigint as n2 from c""")
def region_compare_ks(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return regions.kolmogorov_smirnov(o, "o_totalprice", F.col("o_orderstatus") == "F").withColumn("ks_statistic", r(F.col("ks_statistic"), 9))


@R.add("""with s as (select c_nationkey, c_acctbal - least(min(c_acctbal) over (partition by c_nationkey), 0) as v from customer), k as (select *, row_number() over (partition by c_nationkey order by v) as i from s)
select c_nationkey, round(case when sum(v) = 0 then 0 else 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*)::double end, 6) as gini from k group by 1""")
def gini_by_nation(spark, d):
    return regions.gini(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal").withColumn("gini", r(F.col("gini")))


@R.add("""with e as (select c_nationkey, count(*) as events, count(distinct o_custkey) as people from orders join customer on o_custkey = c_custkey group by 1)
select c_nationkey, events, people, round(events / nullif(c_nationkey, 0)::double, 6) as density, round(events / nullif(people, 0)::double, 6) as per_capita from e""")
def indicators(spark, d):
    e = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("events"), F.count_distinct("o_custkey").alias("people"))
    return regions.rates(e, "events", "people", "c_nationkey").withColumns({c: r(F.col(c)) for c in ("density", "per_capita")})


@R.add("select round(corr(l_quantity, l_extendedprice), 9) as coefficient, count(*) as n from lineitem")
def pearson(spark, d):
    return regions.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select(r(F.col("pearson"), 9).alias("coefficient"), "n")


@R.add("""with k as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2e0 as a, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2e0 as b from lineitem)
select round(corr(a, b), 9) as coefficient, count(*) as n from k""")
def spearman(spark, d):
    t = ranking.percent_rank(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber"), "l_quantity", "a")
    return ranking.percent_rank(t, "l_extendedprice", "b").agg(r(F.corr("a", "b"), 9).alias("coefficient"), F.count("*").alias("n"))


@R.add(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 9) as pearson, round(covar_samp({a}, {b}), 6) as covariance, count(*) as n from lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]))
def corr_matrix(spark, d):
    return regions.correlations(table(spark, d, "lineitem"), MEASURES).withColumn("pearson", r(F.col("pearson"), 9)).withColumn("covariance", r(F.col("covariance"))).drop("p_value")


@R.add("""select event_type, date_trunc('hour', ts)::timestamp as hour, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median from events group by 1, 2""")
def hourly(spark, d):
    out = temporal.hourly(table(spark, d, "events"), F.col("ts"), "value", ["event_type"])
    return out.select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "n", r(F.col("mean")).alias("mean"), r(F.col("median")).alias("median"))


@R.add("""with a as (select *, case when count(value) over w >= 5 then quantile_cont(value, 0.5) over w end as med from events window w as (partition by event_type order by ts, event_id rows between 10 preceding and 10 following)),
b as (select *, abs(value - med) as dev from a), c as (select *, case when count(dev) over w >= 5 then quantile_cont(dev, 0.5) over w end as mad from b window w as (partition by event_type order by ts, event_id rows between 10 preceding and 10 following)),
g as (select event_type, quantile_cont(dev, 0.5) as m from b group by 1)
select event_id, round(med, 6) as med, round(mad, 6) as mad, round(coalesce(dev / (1.4826e0 * nullif(mad, 0)), dev / (m + 1e-12)), 6) as robust_z from c join g using (event_type)""")
def rolling_mad(spark, d):
    out = temporal.rolling_deviation(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value", 21)
    return out.select("event_id", r(F.col("med")).alias("med"), r(F.col("mad")).alias("mad"), r(F.col("robust_z")).alias("robust_z"))


@R.add("""with a as (select *, abs(value - coalesce(lag(value) over (partition by event_type order by ts, event_id), value)) as diff from events), m as (select event_type, quantile_cont(diff, 0.5) as m from a group by 1),
o as (select a.*, m, abs(diff - m) as o from a join m using (event_type)), s as (select event_type, quantile_cont(o, 0.5) + 1e-12 as s from o group by 1)
select event_id, event_type, round(diff, 6) as diff, round((diff - m) / (1.4826e0 * s), 6) as change_score from o join s using (event_type) where (diff - m) / (1.4826e0 * s) > 2e0""")
def change_points(spark, d):
    out = temporal.change_points(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value", 2.0)
    return out.select("event_id", "event_type", r(F.col("diff")).alias("diff"), r(F.col("change_score")).alias("change_score"))


@R.add("""with s as (select event_type, value, row_number() over (partition by event_type order by ts, event_id) - 1 as i from events)
select event_type, round(regr_slope(value, i), 9) as slope, round(regr_intercept(value, i) + regr_slope(value, i) * count(*), 6) as next_value, count(*) as n from s group by 1""")
def trend_slope(spark, d):
    out = temporal.trend(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value")
    return out.select("event_type", r(F.col("slope"), 9).alias("slope"), r(F.col("next_value")).alias("next_value"), "n")


@R.add("""select l_returnflag, count(*) as n, round(avg(l_extendedprice), 6) as mean, round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(stddev_pop(l_extendedprice), 4) as std, min(l_extendedprice) as low, max(l_extendedprice) as high,
 round(quantile_cont(l_extendedprice, 0.05), 6) as p05, round(quantile_cont(l_extendedprice, 0.95), 6) as p95 from lineitem where l_linestatus = 'O' group by 1""")
def zonal(spark, d):
    c = F.col("l_extendedprice")
    q = table(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.avg(c)).alias("mean"), quantile(c, [0.05, 0.5, 0.95]).alias("q"), r(F.stddev_pop(c), 4).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))
    return q.select("l_returnflag", "n", "mean", r(F.col("q")[1]).alias("median"), "std", "low", "high", r(F.col("q")[0]).alias("p05"), r(F.col("q")[2]).alias("p95"))


@R.add("""select event_type, count(*) as n, count(distinct user_id) as users, count_if(value > 100) as large from events group by 1""")
def event_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 100).alias("large"))


@R.add("""select row_id, case when isinf(FRP) or isnan(FRP) then null else FRP end as frp from fire_points order by md5(row_id::varchar) limit 200""")
def random_sample(spark, d):
    """Sampling without replacement: the rows of the smallest hashes, a bounded heap per task."""
    return table(spark, d, "fire_points").select("row_id", finite(F.col("FRP")).alias("frp")).orderBy(F.md5(F.col("row_id").cast("string"))).limit(200)


@R.add("""with o as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from events),
w as (select *, least(101, greatest(11, n // 5 * 2 + 1)) as w from o), m as (select a.user_id, a.i, a.value, a.w, case when count(b.value) >= greatest(5, a.w // 5) then quantile_cont(b.value, 0.5) end as med from w a join w b on a.user_id = b.user_id and abs(a.i - b.i) <= a.w // 2 group by a.user_id, a.i, a.value, a.w),
d as (select *, abs(value - med) as dev from m), k as (select a.user_id, a.i, a.dev, case when count(b.dev) >= greatest(5, a.w // 5) then quantile_cont(b.dev, 0.5) end as mad from d a join d b on a.user_id = b.user_id and abs(a.i - b.i) <= a.w // 2 group by a.user_id, a.i, a.dev, a.w),
g as (select user_id, quantile_cont(dev, 0.5) as whole from d group by 1)
select o.event_id, round(coalesce(dev / (1.4826e0 * nullif(mad, 0)), dev / (whole + 1e-12)), 6) as robust_z from k join o on o.user_id = k.user_id and o.i = k.i join g on g.user_id = k.user_id""")
def temporal_deviation(spark, d):
    """Robust deviation of each event from its user's course, with a window as wide as the series allows."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return temporal.adaptive_deviation(e, ["user_id"], ["ts", "event_id"], "value").select("event_id", r(F.col("robust_z")).alias("robust_z"))
