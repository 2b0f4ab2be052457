"""Multivariate and geometric detectors, the ensemble over their scores, and its explanations and checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.stats import MAD_SIGMA, euclid, quantile
from terravane.operators.featurespace import per_neighbourhood
from terravane.operators.ranking import quantiles
from terravane.session import cut

#: Default weights of the six components.
WEIGHTS = {"score_mahal": 0.20, "score_probability": 0.25, "score_spd": 0.18, "score_procrustes": 0.10, "score_spatial": 0.17, "score_temporal": 0.10}
HIGH = 0.95


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and sample covariance from one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))]), cov


def quadratic(columns: list[str], centre: np.ndarray, inverse: np.ndarray) -> Column:
    """Mahalanobis distance as one expression."""
    d = [F.col(c) - float(m) for c, m in zip(columns, centre)]
    total = F.lit(0.0)
    for i in range(len(d)):
        for j in range(len(d)):
            total = total + d[i] * d[j] * float(inverse[i, j])
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def mahalanobis(df: DataFrame, columns: list[str], out: str = "distance", ridge: float = 1e-6) -> DataFrame:
    centre, cov = moments(df, columns)
    return df.withColumn(out, quadratic(columns, centre, np.linalg.pinv(cov + np.eye(len(columns)) * ridge)))


def robust_mahalanobis(df: DataFrame, columns: list[str], out: str = "distance", steps: int = 12) -> DataFrame:
    """Minimum covariance determinant by concentration steps from the coordinatewise median (Rousseeuw and Van Driessen 1999), with
    consistency scaling and one reweighting. A step is one quantile and one covariance aggregate over all rows."""
    p = len(columns)
    rows = cut(df)
    mid = rows.agg(*[quantile(F.col(c), [0.25, 0.5, 0.75]).alias(c) for c in columns]).first()
    centre = np.array([mid[c][1] for c in columns])
    inverse = np.diag([1 / max(((mid[c][2] - mid[c][0]) / 1.349) ** 2, 1e-12) for c in columns])
    share = 0.5 + (p + 1) / (2 * max(rows.count(), 1))
    last = np.inf
    for _ in range(steps):
        d = rows.withColumn("__d", quadratic(columns, centre, inverse))
        edge = d.agg(F.percentile_approx("__d", F.lit(share), F.lit(100_000))).first()[0]
        centre, cov = moments(d.where(F.col("__d") <= edge), columns)
        inverse = np.linalg.pinv(cov + np.eye(p) * 1e-9)
        det = float(np.linalg.slogdet(cov + np.eye(p) * 1e-9)[1])
        if det >= last - 1e-9:
            break
        last = det
    median = rows.agg(F.percentile_approx(quadratic(columns, centre, inverse), F.lit(0.5), F.lit(100_000))).first()[0]
    factor = median**2 / _chi2_quantile(0.5, p)
    inverse = inverse / max(factor, 1e-300)
    kept = rows.where(quadratic(columns, centre, inverse) <= float(np.sqrt(_chi2_quantile(0.975, p))))
    centre, cov = moments(kept, columns)
    return rows.withColumn(out, quadratic(columns, centre, np.linalg.pinv(cov + np.eye(p) * 1e-9)))


def _chi2_quantile(q: float, k: int) -> float:
    from terravane.functions.distributions import Cdf

    return Cdf("chi2", (float(k), 0.0, 1.0)).quantile(q)


def nearest_spd(a: np.ndarray, least: float = 1e-8) -> np.ndarray:
    a = (np.asarray(a, float) + np.asarray(a, float).T) / 2
    v, q = np.linalg.eigh(a)
    return (q * np.maximum(v, least)) @ q.T


def affine_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Affine-invariant distance of two SPD matrices (Pennec et al. 2006)."""
    low = np.linalg.inv(np.linalg.cholesky(nearest_spd(a)))
    v = np.linalg.eigvalsh(low @ nearest_spd(b) @ low.T)
    return float(np.sqrt((np.log(np.clip(v, 1e-15, None)) ** 2).sum()))


def feature_spd(df: DataFrame, columns: list[str], k: int = 25, out: str = "spd") -> DataFrame:
    """Distance of the covariance of each row's k nearest rows in feature space to that of all rows; a row is not its own neighbour.

    Neighbours are exact and looked for among all rows, whatever their number.
    """
    _, cov = moments(df, columns)
    size = len(columns)
    low = np.linalg.inv(np.linalg.cholesky(nearest_spd(cov + np.eye(size) * 1e-6)))
    near = min(max(k, size + 2), max(df.count() - 1, 1))

    def score(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        n, w = rows.sum(axis=1)[:, None, None], rows[:, :, None]
        c = x - (x * w).sum(axis=1, keepdims=True) / np.maximum(n, 1)
        m = np.einsum("bki,bkj->bij", c * w, c) / np.maximum(n - 1, 1) + np.eye(size) * 1e-6
        v = np.linalg.eigvalsh(low @ m @ low.T)
        return np.sqrt((np.log(np.clip(v, 1e-15, None)) ** 2).sum(axis=1))

    return per_neighbourhood(df, columns, near, score, out)


def procrustes(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, procrustes): disparity of each neighbourhood, the point itself included, from the component-wise median shape."""
    p = points.select("id", "x", "y")
    self_ = p.select(F.col("id").alias("i"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-1).cast("long").alias("j"))
    own, other = p.select(F.col("id").alias("i"), F.col("x").alias("x0"), F.col("y").alias("y0")), p.select(F.col("id").alias("j"), "x", "y")
    near = edges.select("i", "j").join(own, "i").join(other, "j").select("i", (F.col("x") - F.col("x0")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy"), "j").unionByName(self_)
    cloud = near.groupBy("i").agg(F.array_sort(F.collect_list(F.struct(F.atan2("dy", "dx").alias("a"), "j", "dx", "dy"))).alias("c"), F.sqrt(F.sum(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("s"))
    scale = F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0))
    flat = cloud.select("i", F.posexplode("c").alias("pos", "e"), scale.alias("s")).select("i", "pos", (F.col("e.dx") / F.col("s")).alias("dx"), (F.col("e.dy") / F.col("s")).alias("dy"))
    ref = [(r["pos"], r["x"], r["y"]) for r in flat.groupBy("pos").agg(quantile(F.col("dx"), 0.5).alias("x"), quantile(F.col("dy"), 0.5).alias("y")).collect()]  # k+1 rows
    shape = np.array([[x, y] for _, x, y in sorted(ref)])
    if not len(shape) or np.allclose(shape, shape.mean(axis=0)):
        return cloud.select(F.col("i").alias("id"), F.lit(1.0).alias("procrustes"))
    shape = shape - shape.mean(axis=0)
    shape = shape / np.linalg.norm(shape)
    # of two centred shapes of size 1 the disparity is 1 less the squared sum of the singular values of their 2 x 2 product
    at = lambda c: F.element_at(F.array(*[F.lit(float(v)) for v in shape[:, c]]), F.col("pos") + 1)
    sums = {f"m{c}{n}": F.sum(at(c) * F.col(n)) for c in (0, 1) for n in ("dx", "dy")}
    size = lambda c: F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) / F.count("*")
    told = flat.where(F.col("pos") < len(shape)).groupBy("i").agg(*[v.alias(k) for k, v in sums.items()], (size("dx") + size("dy")).alias("norm"), F.count("*").alias("n"))
    squares = F.col("m0dx") * F.col("m0dx") + F.col("m0dy") * F.col("m0dy") + F.col("m1dx") * F.col("m1dx") + F.col("m1dy") * F.col("m1dy")
    singular = squares + 2 * F.abs(F.col("m0dx") * F.col("m1dy") - F.col("m0dy") * F.col("m1dx"))
    fit = F.when((F.col("n") == len(shape)) & (F.col("norm") > 1e-24), 1 - singular / F.col("norm")).otherwise(F.lit(1.0))
    return told.select(F.col("i").alias("id"), fit.alias("procrustes"))


def consensus(df: DataFrame, columns: list[str]) -> DataFrame:
    """consensus_methods and anomaly_reason: how many and which of the scores reach HIGH."""
    high = F.filter(F.array(*[F.when(F.col(c) >= HIGH, c.removeprefix("score_")) for c in columns]), lambda c: c.isNotNull())
    out = df.withColumn("__high", high).withColumn("consensus_methods", F.size("__high"))
    return out.withColumn("anomaly_reason", F.when(F.col("consensus_methods") > 0, F.array_join("__high", ",")).otherwise("ensemble")).drop("__high")


def ensemble(df: DataFrame, weights: dict[str, float], levels: tuple[float, ...] = (0.90, 0.95, 0.99)) -> DataFrame:
    """Weighted score, flags at empirical quantiles, level, consensus, reason, candidate, noise and status."""
    w = {c: max(0.0, float(v)) for c, v in weights.items()}
    if sum(w.values()) <= 0:
        raise ValueError("at least one weight must be positive")
    total = sum(w.values())
    out = df.withColumn("outlier_score", reduce(lambda a, b: a + b, [F.col(c) * (v / total) for c, v in w.items()]))
    cuts = quantiles(out, {"outlier_score": list(levels)})["outlier_score"]
    names = [round(x * 100) for x in levels]
    for n, edge in zip(names, cuts):
        out = out.withColumn(f"outlier_{n}", F.col("outlier_score") >= F.lit(edge).cast("double"))
    level = F.lit("normal")
    for n in names:
        level = F.when(F.col(f"outlier_{n}"), str(n)).otherwise(level)
    out = consensus(out.withColumn("outlier_level", level), list(w))
    out = out.withColumn("anomaly_candidate", F.col("outlier_95")).withColumn("noise_candidate", F.col("outlier_99") & (F.col("consensus_methods") >= 3))
    return out.withColumn("record_status", F.when(F.col("noise_candidate"), "probable_noise").when(F.col("anomaly_candidate"), "valid_anomaly_candidate").otherwise("normal"))


def ablation(df: DataFrame, weights: dict[str, float], level: float = 0.99) -> DataFrame:
    """(component, jaccard, threshold): overlap of the top rows with and without each component, from aggregates without a map of all values."""
    def mix(w: dict[str, float]) -> Column:
        s = sum(w.values())
        return reduce(lambda a, b: a + b, [F.col(c) * (v / s) for c, v in w.items()])

    without = {c: {k: v for k, v in weights.items() if k != c} for c in weights}
    s = df.select(mix(weights).alias("full"), *[mix(w).alias(c) for c, w in without.items()])
    at = {c: F.lit(q[0]).cast("double") for c, q in quantiles(s, {c: [level] for c in s.columns}).items()}
    top = lambda c: F.col(c) >= at[c]
    aggs = s.agg(*[e for c in weights for e in (F.count_if(top("full") & top(c)).alias(f"b_{c}"), F.count_if(top("full") | top(c)).alias(f"u_{c}"))])
    return aggs.select(F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.when(F.col(f"u_{c}") > 0, F.col(f"b_{c}") / F.col(f"u_{c}")).otherwise(F.lit(1.0)).alias("jaccard"), at[c].alias("threshold")) for c in weights])))


def euclidean_intelligence(df: DataFrame, features: list[str], spatial: list[str] | None = None, feature_weight: float = 0.75, spatial_weight: float = 0.25) -> DataFrame:
    """Robust distances from the centre in feature and plane space, their logistic scores, the mix, flags and each feature's share.

    Four small aggregates run at once and give literals: quartiles, median distances, their MADs, and the cuts of the mix.
    The median of a robustly scaled column is 0, so distances are taken from there.
    """
    cols = [*features, *(spatial or [])]
    q = df.agg(*[quantile(F.col(c), [0.25, 0.5, 0.75]).alias(c) for c in cols]).first()
    z = {c: (F.col(c) - float(q[c][1])) / float((q[c][2] - q[c][0]) or 1.0) for c in cols}
    parts = {"feature": (features, feature_weight)} | ({"spatial": (spatial, spatial_weight)} if spatial else {})
    out = df.withColumns({f"{n}_distance": euclid([z[c] for c in cs]) for n, (cs, _) in parts.items()})
    mid = out.agg(*[quantile(F.col(f"{n}_distance"), 0.5).alias(n) for n in parts]).first()
    mad = out.agg(*[quantile(F.abs(F.col(f"{n}_distance") - float(mid[n])), 0.5).alias(n) for n in parts]).first()
    out = out.withColumns({f"{n}_score": 1 / (1 + F.exp(-(F.col(f"{n}_distance") - float(mid[n])) / (MAD_SIGMA * (mad[n] + 1e-12)))) for n in parts})
    total = sum(w for _, w in parts.values())
    out = out.withColumn("intelligence_score", reduce(lambda a, b: a + b, [F.col(f"{n}_score") * (w / total) for n, (_, w) in parts.items()]))
    cuts = out.agg(quantile(F.col("intelligence_score"), [0.90, 0.95, 0.99]).alias("q")).first()["q"]
    out = out.withColumns({f"outlier_{n}": F.col("intelligence_score") >= float(c) for n, c in zip((90, 95, 99), cuts)})
    whole = F.greatest(reduce(lambda a, b: a + b, [F.abs(z[c]) for c in features]), F.lit(1e-12))
    return out.withColumns({f"contrib_{c}": F.abs(z[c]) / whole for c in features})


def against_baseline(current: Column, baseline: Column) -> Column:
    """struct(distance, shared): relative Euclidean distance of two map vectors over their shared keys; NULL below two of them."""
    keys = F.array_intersect(F.map_keys(current), F.map_keys(baseline))
    part = lambda k: F.pow((current[k] - baseline[k]) / F.greatest(F.abs(baseline[k]), F.lit(1e-6)), F.lit(2.0))
    total = F.aggregate(F.transform(keys, part), F.lit(0.0), lambda a, x: a + x)
    return F.struct(F.when(F.size(keys) >= 2, F.sqrt(total)).alias("distance"), F.size(keys).alias("shared"))


def distance_model(df: DataFrame, a: list[str], b: list[str], reference: DataFrame, names: list[str]) -> DataFrame:
    """Euclidean, standardised, Mahalanobis and cosine distance of two vectors per row; reference rows give scale and covariance."""
    _, cov = moments(reference, names)
    inverse = np.linalg.pinv(cov)
    sd = np.sqrt(np.diag(cov))
    d = [F.col(x) - F.col(y) for x, y in zip(a, b)]
    form = F.lit(0.0)
    for i in range(len(d)):
        for j in range(len(d)):
            form = form + d[i] * d[j] * float(inverse[i, j])
    dot = reduce(lambda p, q: p + q, [F.col(x) * F.col(y) for x, y in zip(a, b)])
    na, nb = euclid([F.col(x) for x in a]), euclid([F.col(y) for y in b])
    return df.withColumns({
        "euclidean": euclid(d), "standardized": euclid([x / float(s if s > 0 else 1.0) for x, s in zip(d, sd)]), "mahalanobis": F.sqrt(F.greatest(form, F.lit(0.0))),
        "cosine": F.when((na > 0) & (nb > 0), 1 - dot / (na * nb)),
    })


MAX_SCORED = 20_000


def transfer(rows: DataFrame, scored: DataFrame, columns: list[str], score: str, key: str = "id", most: int = MAX_SCORED) -> DataFrame:
    """(key, score, source): the score of the nearest scored row in feature space, ties by the smaller key; a scored row keeps its own.

    scored has at most ``most`` rows, which is checked; it goes to every task. Rows without all features get NULL.
    """
    held = scored.dropna(subset=columns).select(key, *columns, score).limit(most + 1).toPandas().sort_values(key)
    if len(held) > most:
        raise ValueError(f"more than {most} scored rows")
    x, ids, values = held[columns].to_numpy(float), held[key].to_numpy(), held[score].to_numpy(float)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = np.stack([pc.fill_null(b[c].cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            found = np.full(len(q), -1)
            step = max(1, 2_000_000 // max(1, len(x)))
            for s in range(0, len(q) if len(x) else 0, step):
                d = ((q[s : s + step, None] - x[None]) ** 2).sum(axis=2)
                known = ~np.isnan(d[:, 0])
                found[s : s + step][known] = d[known].argmin(axis=1)
            lost = found < 0
            take = np.where(lost, 0, found)
            value = values[take] if len(x) else np.zeros(len(q))
            source = ids[take] if len(x) else np.zeros(len(q), np.int64)
            yield pa.RecordBatch.from_arrays([b[key], pa.array(value, pa.float64(), mask=lost), pa.array(source, pa.int64(), mask=lost)], [key, score, "source"])

    return rows.select(key, *columns).mapInArrow(ask, f"{key} long, {score} double, source long")
