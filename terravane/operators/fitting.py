"""Fitting candidate densities to a column, histograms, distances of distributions and tail scores.

Closed forms take one aggregate. The others are fitted by Nelder-Mead on a compressed copy of the column: a fine histogram
of bounded size, which is what the driver holds; the final likelihood and all measures of fit are then taken over every row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.distributions import SHAPES, Cdf, integral_column, legendre, log_pdf, log_pdf_column, pdf
from terravane.functions.stats import finite
from terravane.operators.ranking import ranked_counts, value_counts
from terravane.session import cut

CELLS = 4_000
FLOOR = 1e-15


def histogram(df: DataFrame, value: str, bins: int = 80) -> DataFrame:
    """(bin 0..bins-1, low, high, n, p): equal bins over the range, the last closed; empty bins are kept, p is floored and renormalised."""
    v = df.select(finite(F.col(value).cast("double")).alias("v")).where("v is not null")
    lim = v.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    a, b = lim.select("a").scalar(), lim.select("b").scalar()
    width = F.when(b > a, (b - a) / bins).otherwise(F.lit(1.0))
    n = v.groupBy(F.least(F.floor((F.col("v") - a) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    h = every.join(n, "bin", "left").select("bin", (a + F.col("bin") * width).alias("low"), (a + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    total = h.agg(F.sum("n").alias("t"))
    h = h.withColumn("p", F.greatest(F.col("n") / total.scalar(), F.lit(FLOOR)))
    s = h.agg(F.sum("p").alias("s"))
    return h.withColumn("p", F.col("p") / s.scalar())


def against_density(hist: DataFrame, log_density: Column) -> DataFrame:
    """(bhattacharyya, fisher_rao) of a histogram and a density taken at the bin centres; ``log_density`` is an expression of the column ``mid``."""
    h = hist.withColumn("mid", (F.col("low") + F.col("high")) / 2).withColumn("q", F.greatest(F.coalesce(F.exp(log_density), F.lit(0.0)), F.lit(FLOOR)))
    s = h.agg(F.sum("q").alias("s"))
    both = h.agg(F.sum(F.sqrt(F.col("p") * F.col("q") / s.scalar())).alias("bc")).select(F.least("bc", F.lit(1.0)).alias("bc"))
    return both.select((-F.log("bc")).alias("bhattacharyya"), (2 * F.acos("bc")).alias("fisher_rao"))


def ks_distance(df: DataFrame, value: str, cdf: Column) -> DataFrame:
    """(ks_statistic, n, ks_pvalue): largest gap between the empirical distribution and ``cdf``, an expression of the column ``value``, and its asymptotic p."""
    c = value_counts(df, value).withColumn("f", cdf)
    told = c.agg(F.max(F.greatest(F.abs(F.col("f") - F.col("below") / F.col("n")), F.abs(F.col("f") - (F.col("below") + F.col("same")) / F.col("n")))).alias("ks_statistic"), F.max("n").alias("n"))
    root = F.sqrt("n")
    t = (root + 0.12 + 0.11 / root) * F.col("ks_statistic")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, j: a + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * t * t))
    return told.withColumn("ks_pvalue", F.when(t < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms))))


def judged_fits(counts: DataFrame, fits: dict[str, tuple[float, ...]]) -> dict[str, tuple[float, float, int]]:
    """(KS distance, log-likelihood, rows of a finite density) of each fit over every row; counts: (value, same, below, n). A batch gives its own share."""
    names = list(fits)
    fields = [f"{k}{i}" for i in range(len(names)) for k in ("k", "l", "r")]

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cdfs = [Cdf(name, fits[name]) for name in names]
        for b in batches:
            if not b.num_rows:
                continue
            v, below, same, n = (b[c].to_numpy() for c in ("value", "below", "same", "n"))
            found: list[float] = []
            for name, cdf in zip(names, cdfs):
                f, ll = np.concatenate([cdf(v[s : s + 65_536]) for s in range(0, len(v), 65_536)]), log_pdf(name, fits[name], v)
                good = np.isfinite(ll)
                gap = float(np.nanmax(np.maximum(np.abs(f - below / n), np.abs(f - (below + same) / n))))
                found += [gap, float((ll[good] * same[good]).sum()), float(same[good].sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in found], fields)

    told = counts.mapInArrow(share, ", ".join(f"{f} double" for f in fields))
    row = told.agg(*[(F.max(f) if f[0] == "k" else F.sum(f)).alias(f) for f in fields]).first()
    return {name: (row[f"k{i}"], row[f"l{i}"], round(row[f"r{i}"])) for i, name in enumerate(names)}


def closed_form(df: DataFrame, value: str) -> DataFrame:
    """(distribution, loc, scale, log_likelihood, aic, bic) of norm, expon, uniform and laplace from two aggregates."""
    v = df.select(finite(F.col(value).cast("double")).alias("v")).where("v is not null")
    s = v.agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.min("v").alias("a"), F.max("v").alias("b"), F.percentile("v", F.lit(0.5)).alias("med"))
    dev = v.agg(F.avg(F.abs(F.col("v") - s.select("med").scalar())).alias("mad"))
    s = s.withColumn("mad", dev.scalar())
    n = F.col("n")
    cells = [("norm", F.col("m"), F.col("sd"), -n * (math.log(math.sqrt(2 * math.pi)) + F.log("sd") + 0.5)), ("expon", F.col("a"), F.col("m") - F.col("a"), -n * (F.log(F.col("m") - F.col("a")) + 1)), ("uniform", F.col("a"), F.col("b") - F.col("a"), -n * F.log(F.col("b") - F.col("a"))), ("laplace", F.col("med"), F.col("mad"), -n * (math.log(2) + F.log("mad") + 1))]
    rows = F.array(*[F.struct(F.lit(k).alias("distribution"), loc.alias("loc"), sc.alias("scale"), ll.alias("log_likelihood"), (4 - 2 * ll).alias("aic"), (2 * F.log(n) - 2 * ll).alias("bic")) for k, loc, sc, ll in cells])
    return s.select(F.inline(rows))


def _nelder_mead(f, start: np.ndarray, steps: int = 600) -> np.ndarray:
    n = len(start)
    simplex = [start] + [start + np.eye(n)[i] * (0.25 * abs(start[i]) + 0.1) for i in range(n)]
    values = [f(p) for p in simplex]
    for _ in range(steps):
        order = np.argsort(values)
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < 1e-9 * (1 + abs(values[0])):
            break
        mid = np.mean(simplex[:-1], axis=0)
        far = mid + (mid - simplex[-1])
        v = f(far)
        if v < values[0]:
            further = mid + 2 * (mid - simplex[-1])
            w = f(further)
            simplex[-1], values[-1] = (further, w) if w < v else (far, v)
        elif v < values[-2]:
            simplex[-1], values[-1] = far, v
        else:
            near = mid + 0.5 * ((far if v < values[-1] else simplex[-1]) - mid)
            w = f(near)
            if w < min(v, values[-1]):
                simplex[-1], values[-1] = near, w
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (p - simplex[0]) for p in simplex[1:]]
                values = [values[0]] + [f(p) for p in simplex[1:]]
    return simplex[int(np.argmin(values))]


def _fit_one(name: str, x: np.ndarray, w: np.ndarray) -> tuple[float, ...]:
    """Maximum-likelihood parameters on weighted cells; scale and shapes are searched on the log scale."""
    n = w.sum()
    mean = (w * x).sum() / n
    sd = math.sqrt(max((w * (x - mean) ** 2).sum() / n, 1e-24))
    low, high = x.min(), x.max()
    gap = max((high - low) * 1e-6, 1e-9)
    bounded = name in ("expon", "uniform", "rayleigh", "lognorm", "gamma", "chi2", "weibull_min", "pareto", "invgauss", "f", "beta")
    loc = low - gap if bounded else high + gap if name == "weibull_max" else mean
    scale = {"pareto": max(low - (low - sd), sd), "uniform": high - low + 2 * gap, "beta": high - low + 2 * gap}.get(name, max(mean - low, 1e-9) if bounded else max(high - mean, 1e-9) if name == "weibull_max" else sd)
    shape0 = {"lognorm": [0.8], "gamma": [1.5], "chi2": [2.5], "weibull_min": [1.3], "weibull_max": [1.3], "t": [5.0], "pareto": [2.0], "invgauss": [0.8], "genextreme": [0.05], "f": [4.0, 8.0], "beta": [2.0, 4.0]}.get(name, [])
    if name == "pareto":
        loc = low - scale - gap
    signed = name == "genextreme"

    def unpack(p: np.ndarray) -> tuple[float, ...]:
        k = len(shape0)
        shapes = [float(v) if signed else float(np.exp(np.clip(v, -20, 12))) for v in p[:k]]
        return (*shapes, float(p[k]) * sd + mean, float(np.exp(np.clip(p[k + 1], -40, 40))) * sd)

    def cost(p: np.ndarray) -> float:
        v = float((w * log_pdf(name, unpack(p), x)).sum())
        return -v / n if math.isfinite(v) else 1e12 + float(np.abs(p).sum())

    start = np.array([*[s if signed else math.log(s) for s in shape0], (loc - mean) / sd, math.log(scale / sd)])
    best = _nelder_mead(cost, start)
    return unpack(_nelder_mead(cost, best))


def counted(df: DataFrame, value: str) -> DataFrame:
    """(value, same): the finite values and how many rows have each, materialised."""
    v = df.select((finite(F.col(value).cast("double")) + F.lit(0.0)).alias("value")).where("value is not null")
    return cut(v.groupBy("value").agg(F.count("*").alias("same")))


def compress(counts: DataFrame, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, int, float, float]:
    """Means and counts of at most 2*cells cells of the column, equal steps in the value and in its logarithm above the minimum, the number of rows, and the ends."""
    lim = counts.agg(F.min("value").alias("a"), F.max("value").alias("b"), F.sum("same").alias("n")).first()
    if not lim["n"]:
        return np.empty(0), np.empty(0), 0, math.nan, math.nan
    span = (lim["b"] - lim["a"]) or 1.0
    u = (F.col("value") - F.lit(lim["a"])) / F.lit(span)
    rows = counts.groupBy(F.floor(u * cells).alias("i"), F.floor(F.log1p(u * 1e6) * (cells / 28.0)).alias("j")).agg(F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(F.sum(F.col("value") * F.col("same")) / F.sum("same")).alias("m"), F.sum("same").alias("c")).toPandas()
    return rows["m"].to_numpy(), rows["c"].to_numpy(float), lim["n"], lim["a"], lim["b"]


def fit_all(df: DataFrame, value: str, names: list[str] | None = None, bins: int = 80, least: int = 30) -> DataFrame:
    """One row per candidate: params, log-likelihood, AIC, BIC, KS, Bhattacharyya, Fisher-Rao, their ranks and the mean rank, best first.

    A candidate whose density is 0 for more than 5 percent of the rows is left out; fewer than ``least`` values are an error.
    """
    return fit_counted(counted(df, value), names, bins, least)


def fit_counted(counts: DataFrame, names: list[str] | None = None, bins: int = 80, least: int = 30) -> DataFrame:
    """``fit_all`` of the column that ``counted`` counts; each candidate is fitted in a task of its own."""
    x, w, n, a, b = compress(counts)
    if n < least:
        raise ValueError(f"at least {least} values are needed")
    spark = counts.sparkSession
    tried = list(names or SHAPES)
    fits = dict(spark.sparkContext.parallelize(tried, len(tried)).map(lambda name: (name, _fit_one(name, x, w))).collect())
    width = (b - a) / bins if b > a else 1.0
    step = F.least(F.floor((F.col("value") - F.lit(a)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    told = {r["bin"]: r["n"] for r in counts.groupBy(step.alias("bin")).agg(F.sum("same").alias("n")).collect()}
    p0 = np.maximum(np.array([told.get(i, 0) for i in range(bins)]) / n, FLOOR)
    mid = ((a + np.arange(bins) * width) + (a + (np.arange(bins) + 1) * width)) / 2
    measures = judged_fits(ranked_counts(counts), fits)
    rows = []
    for name, p in fits.items():
        ks, ll, ok = measures[name]
        if not ok or ok < 0.95 * n:
            continue
        k = len(p)
        q = np.maximum(pdf(name, p, mid), FLOOR)
        bc = min(1.0, float(np.sqrt(p0 / p0.sum() * q / q.sum()).sum()))
        rows.append((name, [float(v) for v in p], float(ll), 2 * k - 2 * ll, k * math.log(n) - 2 * ll, ks, -math.log(max(bc, 1e-300)), 2 * math.acos(bc)))
    out = spark.createDataFrame(rows, "distribution string, params array<double>, log_likelihood double, aic double, bic double, ks double, bhattacharyya double, fisher_rao double")
    from pyspark.sql.window import Window

    ranks = [F.rank().over(Window.orderBy(c)).alias(f"rank_{c}") for c in ("aic", "bic", "ks", "bhattacharyya", "fisher_rao")]  # twenty rows
    ranked = out.select("*", *ranks)
    total = sum((F.col(f"rank_{c}") for c in ("bic", "ks", "bhattacharyya", "fisher_rao")), F.col("rank_aic")) / 5
    return ranked.withColumn("rank_total", total).orderBy("rank_total", "bic", "distribution")


def tail_score(df: DataFrame, value: str, name: str, params: tuple[float, ...], low: float, order: int = 48) -> DataFrame:
    """Adds the two-sided tail area by per-row quadrature from ``low``, and its -log10."""
    c = F.col(value)
    f = integral_column(lambda x: F.exp(log_pdf_column(name, params, x)), F.lit(low), F.greatest(c, F.lit(low)), order)
    cdf = F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0))
    tail = F.greatest(F.least(2 * F.least(cdf, 1 - cdf), F.lit(1.0)), F.lit(1e-15))
    return df.withColumn("tail_area", tail).withColumn("tail_score", -F.log10("tail_area"))


def tails_of(counts: DataFrame, name: str, params: tuple[float, ...], low: float, order: int = 48) -> DataFrame:
    """(value, same, tail_area, tail_score) as ``tail_score`` gives them, a batch of values at a time."""
    x, w = legendre(order)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, f = b["value"].to_numpy(), np.empty(b.num_rows)
            for s in range(0, len(v), 8_192):
                top = np.maximum(v[s : s + 8_192], low)
                half = (top - low) / 2
                f[s : s + 8_192] = half * (pdf(name, params, half[:, None] * x + ((low + top) / 2)[:, None]) * w).sum(axis=1)
            cdf = np.clip(f, 0.0, 1.0)
            tail = np.maximum(np.minimum(2 * np.minimum(cdf, 1 - cdf), 1.0), 1e-15)
            yield pa.RecordBatch.from_arrays([b["value"], b["same"], pa.array(tail), pa.array(-np.log10(tail))], ["value", "same", "tail_area", "tail_score"])

    return counts.select("value", "same").mapInArrow(judge, "value double, same long, tail_area double, tail_score double")


#: Distribution functions in closed form, of the shapes and z = (x - loc) / scale inside the support.
CLOSED: dict[str, Callable[..., Column]] = {
    "expon": lambda z: 1 - F.exp(-F.greatest(z, F.lit(0.0))),
    "uniform": lambda z: F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0)),
    "laplace": lambda z: F.when(z < 0, F.exp(z) / 2).otherwise(1 - F.exp(-z) / 2),
    "logistic": lambda z: 1 / (1 + F.exp(-z)),
    "cauchy": lambda z: 0.5 + F.atan(z) / math.pi,
    "gumbel_r": lambda z: F.exp(-F.exp(-z)),
    "gumbel_l": lambda z: 1 - F.exp(-F.exp(z)),
    "rayleigh": lambda z: 1 - F.exp(-F.greatest(z, F.lit(0.0)) * F.greatest(z, F.lit(0.0)) / 2),
    "weibull_min": lambda z, c: 1 - F.exp(-F.pow(F.greatest(z, F.lit(0.0)), F.lit(c))),
    "weibull_max": lambda z, c: F.exp(-F.pow(F.greatest(-z, F.lit(0.0)), F.lit(c))),
    "pareto": lambda z, b: F.when(z <= 1, 0.0).otherwise(1 - F.pow(z, F.lit(-b))),
}


def analytic_tail(df: DataFrame, value: str, name: str, params: tuple[float, ...]) -> DataFrame:
    """Adds tail_area and tail_score as ``tail_score`` does, from the distribution function in closed form; an error where there is none."""
    if name not in CLOSED:
        raise ValueError(f"no closed distribution function of {name}; use tail_score")
    *shapes, loc, scale = params
    f = CLOSED[name]((F.col(value) - loc) / scale, *shapes)
    tail = F.greatest(F.least(2 * F.least(f, 1 - f), F.lit(1.0)), F.lit(1e-15))
    return df.withColumn("tail_area", tail).withColumn("tail_score", -F.log10("tail_area"))
