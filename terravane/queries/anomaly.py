"""Distributions, detectors and the ensemble over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.common import table
from terravane.functions.distributions import central_areas, inflections
from terravane.operators import detect, fitting, geometry, neighbours, ranking
from terravane.plans import analysis
from terravane.queries.registry import Registry
from terravane.queries.spatial import _knn_sql, edges, pts
from terravane.queries.tabular import MEASURES, r, wgs
from terravane.session import cut

R = Registry()
QUERIES, SQL = R.queries, R.sql
PRICE = "part"
_HIST = """lim as (select min(p_retailprice) as a, max(p_retailprice) as b, count(*)::double as n from part),
h as (select least(floor((p_retailprice - a) / ((b - a) / 80)), 79)::int as bin, count(*) as n from part, lim group by 1),
hist as (select i::int as bin, a + i * ((b - a) / 80) as low, a + (i + 1) * ((b - a) / 80) as high, coalesce(h.n, 0) as n, greatest(coalesce(h.n, 0) / lim.n, 1e-15) as p0 from range(80) t(i) left join h on h.bin = i, lim),
hp as (select *, p0 / sum(p0) over () as p, (low + high) / 2 as mid from hist), s as (select avg(p_retailprice) as m, stddev_pop(p_retailprice) as sd from part),
q as (select p, greatest(exp(-0.5e0 * pow((mid - m) / sd, 2) - ln(sd) - 0.9189385332046727e0), 1e-15) as q0 from hp, s), bc as (select least(1e0, sum(sqrt(p * q0 / (select sum(q0) from q)))) as bc from q)"""


def price(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice")


def _norm(spark, d):
    s = price(spark, d).agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s")).first()
    return s["m"], s["s"]


@R.add(f"with {_HIST} select bin, round(low, 6) as low, round(high, 6) as high, n, round(p, 9) as p from hp")
def histogram80(spark, d):
    h = fitting.histogram(price(spark, d), "p_retailprice")
    return h.select("bin", r(F.col("low")).alias("low"), r(F.col("high")).alias("high"), "n", r(F.col("p"), 9).alias("p"))


def _distances(spark, d):
    m, s = _norm(spark, d)
    return fitting.against_density(fitting.histogram(price(spark, d), "p_retailprice"), fitting.log_pdf_column("norm", (m, s), F.col("mid")))


@R.add(f"with {_HIST} select round(-ln(bc), 9) as bhattacharyya from bc")
def bhattacharyya_norm(spark, d):
    return _distances(spark, d).select(r(F.col("bhattacharyya"), 9).alias("bhattacharyya"))


@R.add(f"with {_HIST} select round(2 * acos(bc), 9) as fisher_rao from bc")
def fisher_rao_norm(spark, d):
    return _distances(spark, d).select(r(F.col("fisher_rao"), 9).alias("fisher_rao"))


@R.add("""with s as (select min(p_retailprice) as a, avg(p_retailprice) as m, count(*)::double as n from part), g as (select p_retailprice as v, count(*) as c from part group by 1), k as (select v, sum(c) over (order by v) as hi, sum(c) over (order by v) - c as lo from g), d as (select max(greatest(abs(1 - exp(-(v - a) / (m - a)) - lo / n), abs(1 - exp(-(v - a) / (m - a)) - hi / n))) as d, max(n) as n from k, s), t as (select d, n, (sqrt(n) + 0.12e0 + 0.11e0 / sqrt(n)) * d as t from d)
select round(d, 9) as ks_statistic, n::bigint as n, round(greatest(0, least(1, list_sum([2 * case when j % 2 = 1 then 1 else -1 end * exp(-2e0 * j * j * t * t) for j in range(1, 101)]))), 9) as ks_pvalue from t""")
def ks_expon(spark, d):
    s = price(spark, d).agg(F.min("p_retailprice").alias("a"), F.avg("p_retailprice").alias("m"))
    a, m = s.select("a").scalar(), s.select("m").scalar()
    out = fitting.ks_distance(price(spark, d), "p_retailprice", 1 - F.exp(-(F.col("value") - a) / (m - a)))
    return out.select(r(F.col("ks_statistic"), 9).alias("ks_statistic"), "n", r(F.col("ks_pvalue"), 9).alias("ks_pvalue"))


@R.add("""with s as (select min(p_retailprice) as a, avg(p_retailprice) - min(p_retailprice) as k, max(p_retailprice) as b, quantile_cont(p_retailprice, 0.5) as med from part), u as (select avg(abs(p_retailprice - med)) as mad from part, s),
c as (select p_partkey, unnest([{'d': 'expon', 'f': 1 - exp(-(p_retailprice - a) / k)}, {'d': 'uniform', 'f': (p_retailprice - a) / (b - a)}, {'d': 'laplace', 'f': case when p_retailprice < med then exp((p_retailprice - med) / mad) / 2 else 1 - exp(-(p_retailprice - med) / mad) / 2 end}]) as x from part, s, u)
select p_partkey, x.d as distribution, round(greatest(2 * least(x.f, 1 - x.f), 1e-15), 9) as tail_area from c""")
def analytic_tails(spark, d):
    """Two-sided tail areas from closed distribution functions."""
    fits = {x["distribution"]: (x["loc"], x["scale"]) for x in fitting.closed_form(price(spark, d), "p_retailprice").collect()}
    out = None
    for name in ("expon", "uniform", "laplace"):
        one = fitting.analytic_tail(price(spark, d), "p_retailprice", name, fits[name]).select("p_partkey", F.lit(name).alias("distribution"), r(F.col("tail_area"), 9).alias("tail_area"))
        out = one if out is None else out.unionByName(one)
    return out


@R.add("""with s as (select count(*)::double as n, avg(p_retailprice) as m, stddev_pop(p_retailprice) as sd, min(p_retailprice) as a, max(p_retailprice) as b, quantile_cont(p_retailprice, 0.5) as med from part), t as (select avg(abs(p_retailprice - med)) as mad from part, s),
f as (select 'norm' as distribution, m as loc, sd as scale, -n * (ln(sqrt(2 * pi())) + ln(sd) + 0.5e0) as ll, n from s union all select 'expon', a, m - a, -n * (ln(m - a) + 1), n from s union all select 'uniform', a, b - a, -n * ln(b - a), n from s union all select 'laplace', med, mad, -n * (ln(2) + ln(mad) + 1), n from s, t)
select distribution, round(loc, 6) as loc, round(scale, 6) as scale, round(ll, 4) as log_likelihood, round(4 - 2 * ll, 4) as aic, round(2 * ln(n) - 2 * ll, 4) as bic from f""")
def fit_closed_form(spark, d):
    out = fitting.closed_form(price(spark, d), "p_retailprice")
    return out.select("distribution", *[r(F.col(c)).alias(c) for c in ("loc", "scale")], *[r(F.col(c), 4).alias(c) for c in ("log_likelihood", "aic", "bic")])


@R.add()
def fit_all(spark, d):
    return fitting.fit_all(price(spark, d), "p_retailprice")


@R.add("""with s as (select min(p_retailprice) as a, avg(p_retailprice) - min(p_retailprice) as k from part), c as (select p_partkey, 1 - exp(-(p_retailprice - a) / k) as f from part, s)
select p_partkey, round(greatest(least(2 * least(f, 1 - f), 1), 1e-15), 8) as tail_area, round(-log10(greatest(least(2 * least(f, 1 - f), 1), 1e-15)), 4) as tail_score from c where f > 1e-6""")
def quadrature_tail_expon(spark, d):
    s = price(spark, d).agg(F.min("p_retailprice").alias("a"), F.avg("p_retailprice").alias("m")).first()
    out = fitting.tail_score(price(spark, d).where(F.col("p_retailprice") > s["a"]), "p_retailprice", "expon", (s["a"], s["m"] - s["a"]), s["a"])
    return out.where(F.col("tail_area") > 2e-6).select("p_partkey", r(F.col("tail_area"), 8).alias("tail_area"), r(F.col("tail_score"), 4).alias("tail_score"))


@R.add("""with s as (select avg(p_retailprice) as m, stddev_pop(p_retailprice) as s from part)
select percent::int as percent, round(m - z * s, 4) as lower, round(m + z * s, 4) as upper, round(percent / 100e0, 7) as area from s, (values (90, 1.6448536269514722e0), (95, 1.959963984540054e0), (99, 2.5758293035489004e0)) t(percent, z)""")
def interval_areas(spark, d):
    m, s = _norm(spark, d)
    out = spark.createDataFrame(central_areas("norm", (m, s)), "percent int, lower double, upper double, area double, error double")
    return out.select("percent", r(F.col("lower"), 4).alias("lower"), r(F.col("upper"), 4).alias("upper"), r(F.col("area"), 7).alias("area"))


@R.add()
def derivative_features(spark, d):
    """Density, its derivatives and the distance to the nearest inflection per row, by arithmetic on a uniform grid."""
    m, s = _norm(spark, d)
    g = inflections("norm", (m, s))
    x, step, n = g["x"], g["x"][1] - g["x"][0], len(g["x"])
    pos = (F.col("p_retailprice") - float(x[0])) / float(step)
    i = F.least(F.greatest(F.floor(pos), F.lit(0)), F.lit(n - 2)).cast("int")
    inside = (pos >= 0) & (pos <= n - 1)

    def at(name: str):
        grid = F.array(*[F.lit(float(v)) for v in g[name]])
        return F.when(inside, grid[i] + (grid[i + 1] - grid[i]) * (pos - i)).otherwise(F.lit(0.0))

    dist = F.array_min(F.array(*[F.abs(F.col("p_retailprice") - float(v)) for v in g["roots"]])) if len(g["roots"]) else F.lit(None).cast("double")
    return price(spark, d).select("p_partkey", at("pdf").alias("pdf_value"), at("d1").alias("pdf_derivative_1"), at("d2").alias("pdf_derivative_2"), dist.alias("distance_to_inflection"), (dist <= 0.05 * s).alias("is_inflection_zone"))


@R.add("""with s as (select avg(l_quantity) as a, avg(l_discount) as b, var_samp(l_quantity) + 1e-6 as aa, var_samp(l_discount) + 1e-6 as bb, covar_samp(l_quantity, l_discount) as ab from lineitem)
select l_orderkey, l_linenumber, round(sqrt(((l_quantity - a) * (l_quantity - a) * bb - 2 * (l_quantity - a) * (l_discount - b) * ab + (l_discount - b) * (l_discount - b) * aa) / (aa * bb - ab * ab)), 6) as distance from lineitem, s""")
def mahalanobis_plain(spark, d):
    return detect.mahalanobis(table(spark, d, "lineitem"), ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", r(F.col("distance")).alias("distance"))


@R.add()
def mahalanobis_mcd(spark, d):
    return detect.robust_mahalanobis(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *MEASURES), MEASURES)


@R.add()
def spd_score(spark, d):
    return detect.feature_spd(pts(spark, d), ["x", "y", "v", "u"])


@R.add(f"""with {_knn_sql(11)}, o as (select e.i, b.x - a.x as dx, b.y - a.y as dy, j from e join pts a on a.id = e.i join pts b on b.id = e.j union all select id, 0e0, 0e0, -1 from pts),
f as (select i, row_number() over (partition by i order by atan2(dy, dx), j) as k, dx / sqrt(sum(dx * dx + dy * dy) over (partition by i)) as x, dy / sqrt(sum(dx * dx + dy * dy) over (partition by i)) as y from o),
r0 as (select k, quantile_cont(x, 0.5) as x, quantile_cont(y, 0.5) as y from f group by k), r1 as (select k, x - avg(x) over () as x, y - avg(y) over () as y from r0), ref as (select k, x / sqrt(sum(x * x + y * y) over ()) as x, y / sqrt(sum(x * x + y * y) over ()) as y from r1),
m as (select i, sum(ref.x * f.x) as a, sum(ref.x * f.y) as b, sum(ref.y * f.x) as c, sum(ref.y * f.y) as d, sum(f.x * f.x + f.y * f.y) - (sum(f.x) * sum(f.x) + sum(f.y) * sum(f.y)) / count(*) as n from f join ref using (k) group by i)
select i as id, round(1 - (a * a + b * b + c * c + d * d + 2 * abs(a * d - b * c)) / n, 6) as procrustes from m""")
def procrustes_score(spark, d):
    return detect.procrustes(pts(spark, d), edges(spark, d, 11)).withColumn("procrustes", r(F.col("procrustes")))


_PARTS = ["score_mahal", "score_probability", "score_temporal"]
_COLS = {"score_mahal": "l_quantity", "score_probability": "l_extendedprice", "score_temporal": "l_discount"}
_W = {"score_mahal": 0.4, "score_probability": 0.35, "score_temporal": 0.25}
_COMP = "k as (select l_orderkey, l_linenumber, " + ", ".join(f"(rank() over (order by {v}) + (count(*) over (partition by {v}) - 1) / 2e0) / count(*) over () as {c}" for c, v in _COLS.items()) + " from lineitem)"
_ENS = f"{_COMP}, e as (select *, 0.4e0 * score_mahal + 0.35e0 * score_probability + 0.25e0 * score_temporal as sc from k), t as (select quantile_cont(sc, [0.9, 0.95, 0.99]) as q from e)"


def components_table(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_COLS.values())
    return ranking.percent_ranks(t, {v: c for c, v in _COLS.items()}, keep=True).select("l_orderkey", "l_linenumber", *_PARTS)


@R.add(f"with {_ENS} select l_orderkey, l_linenumber, round(sc, 9) as outlier_score, sc >= q[1] as outlier_90, sc >= q[2] as outlier_95, sc >= q[3] as outlier_99, case when sc >= q[3] then '99' when sc >= q[2] then '95' when sc >= q[1] then '90' else 'normal' end as outlier_level from e, t")
def ensemble_flags(spark, d):
    e = detect.ensemble(components_table(spark, d), _W)
    return e.select("l_orderkey", "l_linenumber", r(F.col("outlier_score"), 9).alias("outlier_score"), "outlier_90", "outlier_95", "outlier_99", "outlier_level")


_CONS = "(score_mahal >= 0.95)::int + (score_probability >= 0.95)::int + (score_temporal >= 0.95)::int"


@R.add(f"with {_COMP} select l_orderkey, l_linenumber, ({_CONS})::int as consensus_methods, coalesce(nullif(concat_ws(',', case when score_mahal >= 0.95 then 'mahal' end, case when score_probability >= 0.95 then 'probability' end, case when score_temporal >= 0.95 then 'temporal' end), ''), 'ensemble') as anomaly_reason from k")
def consensus_reason(spark, d):
    return detect.consensus(components_table(spark, d), list(_W)).select("l_orderkey", "l_linenumber", "consensus_methods", "anomaly_reason")


@R.add(f"with {_ENS} select case when sc >= q[3] and {_CONS} >= 3 then 'probable_noise' when sc >= q[2] then 'valid_anomaly_candidate' else 'normal' end as record_status, count(*) as n from e, t group by 1")
def noise_filter(spark, d):
    return detect.ensemble(components_table(spark, d), _W).groupBy("record_status").agg(F.count("*").alias("n"))


def _abl(c: str) -> str:
    keep = {k: v for k, v in _W.items() if k != c}
    s = sum(keep.values())
    return f"select '{c}' as component, count_if(sc >= q0 and x >= q1) / count_if(sc >= q0 or x >= q1)::double as j, any_value(q1) as th from (select *, quantile_cont(sc, 0.99) over () as q0, quantile_cont(x, 0.99) over () as q1 from (select sc, {' + '.join(f'{v / s}e0 * {k}' for k, v in keep.items())} as x from e))"


@R.add(f"with {_ENS}, a as ({' union all '.join(_abl(c) for c in _W)}) select component, round(j, 9) as jaccard, round(th, 9) as threshold from a")
def ablation_jaccard(spark, d):
    a = detect.ablation(components_table(spark, d), _W)
    return a.select("component", r(F.col("jaccard"), 9).alias("jaccard"), r(F.col("threshold"), 9).alias("threshold"))


@R.add()
def bootstrap_winner(spark, d):
    """Winning candidate of each bootstrap draw; a draw is an equi-join of hashed positions with the numbered rows."""
    src = ranking.ordinal01(price(spark, d), "p_retailprice", "p_partkey", "pos").select("p_retailprice", "pos")
    n = src.count()
    numbered = cut(src.select("p_retailprice", F.round(F.col("pos") * (n - 1)).cast("long").alias("k")))
    out = []
    for b in range(5):
        drawn = spark.range(n).select(F.pmod(F.xxhash64(F.lit(b), "id"), F.lit(n)).alias("k")).join(numbered, "k").select("p_retailprice")
        out.append(fitting.fit_all(drawn, "p_retailprice", ["norm", "expon", "uniform", "laplace", "logistic", "gamma"], 60).limit(1).select(F.lit(b).alias("draw"), "distribution"))
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    return both.groupBy("distribution").agg(F.count("*").alias("wins")).withColumn("stability", F.col("wins") / 5)


@R.add()
def variable_comparison(spark, d):
    """Best fit, tail and the counts of rows that stand out, per measure; an item lies where its customer does, and its series is their nation."""
    n = wgs(spark, d).select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", *[c.alias(a) for c, a in zip(geometry.utm(F.col("lat"), F.col("lon"), 18), ("x", "y"))])
    at = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(n, "o_custkey", "left").drop("o_custkey")  # orders first, so that items move once
    measures = ["l_quantity", "l_extendedprice", "l_discount"]
    apart = ["l_partkey", "l_suppkey", *measures]  # items that are alike in these may take each other's id
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *apart, "l_shipdate").join(at, "l_orderkey", "left")
    alike = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*apart)  # a line number is not unique in its order
    rows = items.withColumn("id", (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")) * (1 << 20) + F.row_number().over(alike))
    return analysis.compare_variables(rows, measures, "c_nationkey", ["l_shipdate"])


_EI = """w as (select c_custkey, c_acctbal, -75 + (c_custkey * 37 % 1009) / 1e3 as lon, 6 + (c_custkey * 91 % 1013) / 1e3 as lat, c_nationkey::double as nk from customer),
q as (select quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) as a, quantile_cont(nk, [0.25, 0.5, 0.75]) as b, quantile_cont(lon, [0.25, 0.5, 0.75]) as x, quantile_cont(lat, [0.25, 0.5, 0.75]) as y from w),
z as (select c_custkey, (c_acctbal - a[2]) / (a[3] - a[1]) as za, (nk - b[2]) / (b[3] - b[1]) as zb, (lon - x[2]) / (x[3] - x[1]) as zx, (lat - y[2]) / (y[3] - y[1]) as zy from w, q),
c as (select quantile_cont(za, 0.5) as a, quantile_cont(zb, 0.5) as b, quantile_cont(zx, 0.5) as x, quantile_cont(zy, 0.5) as y from z),
dd as (select c_custkey, abs(za - a) as oa, abs(zb - b) as ob, sqrt((za - a) * (za - a) + (zb - b) * (zb - b)) as fd, sqrt((zx - x) * (zx - x) + (zy - y) * (zy - y)) as sd from z, c),
m as (select quantile_cont(fd, 0.5) as fm, quantile_cont(sd, 0.5) as sm from dd), s as (select quantile_cont(abs(fd - fm), 0.5) + 1e-12 as fs, quantile_cont(abs(sd - sm), 0.5) + 1e-12 as ss from dd, m),
o as (select *, 0.75e0 / (1 + exp(-(fd - fm) / (1.4826e0 * fs))) + 0.25e0 / (1 + exp(-(sd - sm) / (1.4826e0 * ss))) as sc from dd, m, s)"""


@R.add(f"with {_EI} select c_custkey, round(fd, 6) as feature_distance, round(sd, 6) as spatial_distance, round(sc, 6) as intelligence_score, sc >= (select quantile_cont(sc, 0.95) from o) as outlier_95, round(oa / greatest(oa + ob, 1e-12), 6) as contrib_c_acctbal from o")
def euclidean_intelligence(spark, d):
    w = wgs(spark, d).withColumn("nk", F.col("c_nationkey").cast("double"))
    out = detect.euclidean_intelligence(w, ["c_acctbal", "nk"], ["lon", "lat"])
    return out.select("c_custkey", *[r(F.col(c)).alias(c) for c in ("feature_distance", "spatial_distance", "intelligence_score")], "outlier_95", r(F.col("contrib_c_acctbal")).alias("contrib_c_acctbal"))


@R.add("""with n as (select c_nationkey, avg(c_acctbal) as bal, count(*)::double as n from customer group by 1), b as (select avg(c_acctbal) as bal, count(*) / 25e0 as n from customer)
select c_nationkey, round(sqrt(pow((n.bal - b.bal) / greatest(abs(b.bal), 1e-6), 2) + pow((n.n - b.n) / greatest(abs(b.n), 1e-6), 2)), 6) as distance, 2 as shared from n, b""")
def baseline_vector(spark, d):
    c = table(spark, d, "customer")
    n = c.groupBy("c_nationkey").agg(F.create_map(F.lit("bal"), F.avg("c_acctbal"), F.lit("n"), F.count("*").cast("double"), F.lit("own"), F.lit(1.0)).alias("cur"))
    base = c.agg(F.create_map(F.lit("bal"), F.avg("c_acctbal"), F.lit("n"), F.count("*") / F.lit(25e0)).alias("m"))
    out = n.withColumn("base", base.scalar()).withColumn("o", detect.against_baseline(F.col("cur"), F.col("base")))
    return out.select("c_nationkey", r(F.col("o.distance")).alias("distance"), F.col("o.shared").alias("shared"))


@R.add("""with s as (select sqrt(var_samp(e1)) as s1, sqrt(var_samp(e2)) as s2, var_samp(e1) as aa, var_samp(e2) as bb, covar_samp(e1, e2) as ab from (select embedding[1]::double as e1, embedding[2]::double as e2 from embeddings)),
v as (select vec_id, embedding[1]::double as a1, embedding[2]::double as a2, embedding[3]::double as b1, embedding[4]::double as b2 from embeddings)
select vec_id, round(sqrt(pow(a1 - b1, 2) + pow(a2 - b2, 2)), 6) as euclidean, round(sqrt(pow((a1 - b1) / s1, 2) + pow((a2 - b2) / s2, 2)), 6) as standardized,
 round(sqrt(greatest((pow(a1 - b1, 2) * bb - 2 * (a1 - b1) * (a2 - b2) * ab + pow(a2 - b2, 2) * aa) / (aa * bb - ab * ab), 0)), 6) as mahalanobis, round(1 - (a1 * b1 + a2 * b2) / (sqrt(a1 * a1 + a2 * a2) * sqrt(b1 * b1 + b2 * b2)), 6) as cosine from v, s""")
def distance_model(spark, d):
    p = pts(spark, d)
    out = detect.distance_model(p, ["x", "y"], ["v", "u"], p, ["x", "y"])
    return out.select(F.col("id").alias("vec_id"), *[r(F.col(c)).alias(c) for c in ("euclidean", "standardized", "mahalanobis", "cosine")])


@R.add()
def detector(spark, d):
    """The whole detector over the planar points: robust distance, fitted tail, local covariance, shape, spatial rank and the ensemble."""
    p, e = cut(pts(spark, d)), cut(edges(spark, d, 12))
    best = fitting.fit_all(p, "v", ["norm", "laplace", "logistic"]).first()
    from terravane.functions.distributions import Cdf

    low = Cdf(best["distribution"], tuple(best["params"])).quantile(1e-10)
    scored = detect.robust_mahalanobis(p, ["x", "y", "v", "u"], "mahal").join(fitting.tail_score(p, "v", best["distribution"], tuple(best["params"]), low).select("id", "tail_score"), "id")
    scored = scored.join(detect.feature_spd(p, ["x", "y", "v", "u"]), "id").join(detect.procrustes(p, e), "id").join(neighbours.lof(e), "id")
    scored = cut(scored)
    scored = ranking.percent_ranks(scored, {"mahal": "score_mahal", "tail_score": "score_probability", "spd": "score_spd", "procrustes": "score_procrustes", "lof": "score_spatial"})
    weights = {k: v for k, v in detect.WEIGHTS.items() if k != "score_temporal"}
    return detect.ensemble(cut(scored), weights).select("id", *weights, "outlier_score", "outlier_level", "consensus_methods", "anomaly_reason", "record_status")
