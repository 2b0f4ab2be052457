"""State of territories over time: feature vectors, baselines, trajectories, monitoring, incidents, strategy drift.

State is an append-only log read through "latest by key"; nothing is updated in place. Vectors are maps of numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.common import skew_join
from terravane.functions.stats import MAD_SIGMA, quantile

SEVERITY = ("info", "medium", "high", "critical")


def _away(middle: str) -> Callable[[Column], Column]:
    return lambda v: F.abs(v - F.col(middle))


def _prefixed(group: str) -> Callable[[Column, Column], Column]:
    return lambda k, v: F.concat(F.lit(f"{group}."), k)


def latest(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key; reduces map-side, so a hot key is one row per partition."""
    rest = [c for c in log.columns if c not in keys]
    kept = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__r"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in log.columns])


def latest_values(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Per key the last non-null value of every column, as an upsert that keeps what it is not given."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest])


def fuse(parts: dict[str, Column]) -> Column:
    """One map with keys ``group.feature`` from a map column per group; missing groups add nothing."""
    named = [F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,double>")), _prefixed(g)) for g, m in parts.items()]
    return F.map_concat(*named)


def long_vectors(series: DataFrame, key: str, ts: str, vector: str) -> DataFrame:
    return series.select(key, ts, F.explode(vector).alias("feature", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))


def profile(series: DataFrame, key: str, ts: str, vector: str, window: int = 8, limit: float = 3.5) -> DataFrame:
    """Latest vector of each territory against the median and MAD of the ``window`` vectors before it."""
    flat = long_vectors(series, key, ts, vector)
    w = Window.partitionBy(key, "feature").orderBy(ts)
    before = w.rowsBetween(-window, -1)
    p = flat.withColumn("med", quantile(F.col("value"), 0.5).over(before)).withColumn("__past", F.collect_list("value").over(before)).withColumn("last", F.lead(ts).over(w).isNull())
    p = p.where(F.col("last") & F.col("med").isNotNull())
    spread = F.transform("__past", lambda v: F.abs(v - F.col("med")))
    middle = F.array_sort(spread)
    n = F.size("__past")
    mad = (F.element_at(middle, F.floor((n + 1) / 2).cast("int")) + F.element_at(middle, F.floor(n / 2).cast("int") + 1)) / 2
    scale = F.greatest(MAD_SIGMA * mad, 0.10 * F.abs("med"), F.lit(1e-9))
    p = p.withColumn("z", (F.col("value") - F.col("med")) / scale)
    return p.select(key, ts, "feature", "value", F.col("med").alias("baseline"), "z", (F.abs("z") >= limit).alias("signal"))


def trajectory(series: DataFrame, key: str, t_days: str, features: list[str], baseline: int = 4) -> DataFrame:
    """One row per snapshot: speed, acceleration, step length, displacement and departure from the first ``baseline`` snapshots.

    Features are scaled by their own spread over the territory's snapshots; series: key, t_days (fractional days), features.
    """
    by = Window.partitionBy(key)
    w = by.orderBy(t_days)
    s = series
    for f in features:
        sd = F.stddev_samp(f).over(by)
        s = s.withColumn(f"__s_{f}", F.when(sd > 1e-9, sd).otherwise(F.lit(1.0)))
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for f in features:
        s = s.withColumn(f"__z_{f}", (F.col(f) - F.first(f).over(first)) / F.col(f"__s_{f}"))
    s = s.withColumn("__n", F.row_number().over(w)).withColumn("__c", F.count("*").over(by)).withColumn("dt", F.col(t_days) - F.lag(t_days).over(w))
    for f in features:
        s = s.withColumn(f"__d_{f}", F.col(f"__z_{f}") - F.lag(f"__z_{f}").over(w)).withColumn(f"__v_{f}", F.col(f"__d_{f}") / F.col("dt"))
    mean_dt = (F.col("dt") + F.lag("dt").over(w)) / 2
    for f in features:
        s = s.withColumn(f"__a_{f}", (F.col(f"__v_{f}") - F.lag(f"__v_{f}").over(w)) / mean_dt)
    norm = lambda p: F.sqrt(reduce(lambda a, b: a + b, [F.col(f"__{p}_{f}") * F.col(f"__{p}_{f}") for f in features]))
    s = s.withColumn("speed", norm("v")).withColumn("acceleration", norm("a")).withColumn("step", norm("d")).withColumn("displacement", norm("z"))
    used = F.col("__n") <= F.least(F.lit(max(2, baseline)), F.col("__c") - 1)
    dep = F.lit(0.0)
    for f in features:
        s = s.withColumn(f"__m_{f}", quantile(F.when(used, F.col(f"__z_{f}")), 0.5).over(by))
        s = s.withColumn(f"__r_{f}", F.greatest(MAD_SIGMA * quantile(F.when(used, F.abs(F.col(f"__z_{f}") - F.col(f"__m_{f}"))), 0.5).over(by), F.lit(0.25)))
        q = (F.col(f"__z_{f}") - F.col(f"__m_{f}")) / F.col(f"__r_{f}")
        dep = dep + q * q
    s = s.withColumn("departure", F.sqrt(dep))
    return s.select(key, t_days, F.col("__n").alias("n"), "speed", "acceleration", "step", "displacement", "departure")


def path_summary(traj: DataFrame, key: str) -> DataFrame:
    """(key, path_length, net_displacement, straightness, current_speed, current_departure)."""
    s = traj.groupBy(key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"), F.max_by("displacement", "n").alias("net_displacement"), F.max_by("speed", "n").alias("current_speed"), F.max_by("departure", "n").alias("current_departure"))
    return s.withColumn("straightness", F.when(F.col("path_length") > 1e-12, F.col("net_displacement") / F.col("path_length")).otherwise(F.lit(1.0)))


def speed_changes(traj: DataFrame, key: str) -> DataFrame:
    """Snapshots whose speed passes median + 3.5 robust deviations of the territory's speeds; needs three speeds."""
    by = Window.partitionBy(key)
    s = traj.where("speed is not null").withColumn("__m", quantile(F.col("speed"), 0.5).over(by)).withColumn("__k", F.count("*").over(by))
    s = s.withColumn("threshold", F.col("__m") + 3.5 * F.greatest(MAD_SIGMA * quantile(F.abs(F.col("speed") - F.col("__m")), 0.5).over(by), F.lit(1e-9)))
    return s.where((F.col("__k") >= 3) & (F.col("speed") > F.col("threshold"))).drop("__m", "__k")


def watch(traj: DataFrame, key: str) -> DataFrame:
    """(key, departure_z, departure_level, speed_z, speed_level, status) of the last snapshot against the earlier ones."""
    by = Window.partitionBy(key)
    s = traj.withColumn("__last", F.max("n").over(by))
    out = None
    for c in ("departure", "speed"):
        past = s.where((F.col("n") < F.col("__last")) & F.col(c).isNotNull())
        m = past.groupBy(key).agg(quantile(F.col(c), 0.5).alias("__m"), F.count("*").alias("__k"))
        d = past.join(m, key).groupBy(key).agg(quantile(F.abs(F.col(c) - F.col("__m")), 0.5).alias("__mad"))
        now = s.where(F.col("n") == F.col("__last")).select(key, F.col(c).alias("__v")).join(m, key, "left").join(d, key, "left")
        z = (F.col("__v") - F.col("__m")) / F.greatest(MAD_SIGMA * F.col("__mad"), 0.1 * F.abs("__m"), F.lit(0.25))
        enough = F.coalesce(F.col("__k") >= 2, F.lit(False))
        now = now.withColumn(f"{c}_z", F.when(enough, z).otherwise(F.lit(0.0)))
        level = F.when(~enough, "BASELINE_BUILDING").when(F.col(f"{c}_z") >= 3.5, "HIGH").when(F.col(f"{c}_z") >= 2, "ELEVATED").otherwise("NORMAL")
        part = now.select(key, f"{c}_z", level.alias(f"{c}_level"))
        out = part if out is None else out.join(part, key)
    marked = out.join(speed_changes(traj, key).select(key, F.lit(True).alias("__c")).distinct(), key, "left")
    signal = F.col("departure_level").isin("HIGH", "ELEVATED") | F.col("speed_level").isin("HIGH", "ELEVATED") | F.col("__c").isNotNull()
    status = F.when((F.col("departure_level") == "HIGH") & (F.col("speed_level") == "HIGH"), "HIGH").when(signal, "ELEVATED").otherwise("NORMAL")
    return marked.withColumn("status", status).drop("__c")


def speed_distances(traj: DataFrame, key: str, last: int, blocks: int = 16) -> DataFrame:
    """(a, b, distance) of the last ``last`` speeds of every two territories, matched by position from the end.

    The result holds a row for each two territories; they meet in pairs of ``blocks`` blocks, each a task of its own.
    """
    w = Window.partitionBy(key).orderBy(F.desc("n"))
    s = traj.where("speed is not null").withColumn("back", F.row_number().over(w)).where(F.col("back") <= last)
    kind = traj.schema[key].dataType.simpleString()
    lines = s.groupBy(F.col(key).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("back", "speed"))), lambda x: x["speed"]).alias("speeds"))
    own = lines.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    sent = own.select("k", "speeds", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    sent = sent.select("k", "speeds", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def meet(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        keys, block = t["k"].to_pylist(), t["own"].to_numpy()
        x = np.full((len(keys), last), np.nan)
        for row, speeds in enumerate(t["speeds"].to_pylist()):
            x[row, : len(speeds)] = speeds
        out: list[tuple] = []
        for a in np.flatnonzero(block == i):
            b = np.flatnonzero(block == j)
            gap = (x[b] - x[a]) ** 2
            both = ~np.isnan(gap)
            d = np.sqrt(np.where(both, gap, 0).sum(axis=1))
            for m in np.flatnonzero(both.any(axis=1)):
                if keys[a] < keys[b[m]]:
                    out.append((keys[a], keys[b[m]], float(d[m])))
                elif i != j and keys[b[m]] < keys[a]:
                    out.append((keys[b[m]], keys[a], float(d[m])))
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"a": pa.array(cols[0], t["k"].type), "b": pa.array(cols[1], t["k"].type), "distance": pa.array(cols[2], pa.float64())})

    return sent.groupBy("i", "j").applyInArrow(meet, f"a {kind}, b {kind}, distance double")


def clusters(summary: DataFrame, key: str, k: int = 3, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    cols = ["current_speed", "current_departure", "path_length", "straightness"]
    v = VectorAssembler(inputCols=cols, outputCol="raw").transform(summary.na.fill(0.0, cols))
    z = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    return KMeans(k=k, seed=seed, initSteps=10).fit(z).transform(z).select(key, F.col("prediction").alias("cluster"))


def divergence(labels: list[Column]) -> Column:
    """struct(score, band): share of the pairs of known labels that differ; fewer than two labels give NULL."""
    known = F.array_compact(F.array(*[F.nullif(F.lower(F.trim(c)), F.lit("")) for c in labels]))
    n = F.size(known)
    same = F.aggregate(F.transform(F.array_distinct(known), lambda x: F.size(F.filter(known, lambda y: y == x))), F.lit(0), lambda t, c: (t + c * (c - 1) / 2).cast("int"))
    score = F.when(n >= 2, 1 - same / (n * (n - 1) / 2))
    return F.struct(score.alias("score"), F.when(score < 0.34, "low").when(score < 0.67, "moderate").when(score.isNotNull(), "high").alias("band"))


def monitoring_change(runs: DataFrame, key: str, order: str, metrics: dict[str, float], history: int = 8, least: int = 3, limit: float = 3.5) -> DataFrame:
    """Each run against the median and MAD of the ``history`` runs before it: change score, number of signals and status.

    metrics: metric -> floor of its scale. Runs with fewer than ``least`` before them are still building their baseline.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(-history, -1)
    s = runs.withColumn("__k", F.count("*").over(before))
    devs = []
    for m, floor in metrics.items():
        s = s.withColumn(f"__p_{m}", F.collect_list(m).over(before)).withColumn(f"__m_{m}", quantile(F.col(m), 0.5).over(before))
        middle = F.array_sort(F.transform(f"__p_{m}", _away(f"__m_{m}")))
        n = F.size(f"__p_{m}")
        mad = F.when(n > 0, (F.try_element_at(middle, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(middle, F.floor(n / 2).cast("int") + 1)) / 2)
        s = s.withColumn(f"__d_{m}", F.abs(F.col(m) - F.col(f"__m_{m}")) / F.greatest(MAD_SIGMA * mad, 0.10 * F.abs(F.col(f"__m_{m}")), F.lit(floor)))
        devs.append(F.col(f"__d_{m}"))
    told = F.array_compact(F.array(*[F.least(d / 5, F.lit(1.0)) for d in devs]))  # metrics missing now or before take no part
    score = F.coalesce(F.aggregate(told, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(told), F.lit(0)), F.lit(0.0))
    signals = reduce(lambda a, b: a + b, [F.coalesce(d >= limit, F.lit(False)).cast("int") for d in devs])
    ready = F.col("__k") >= least
    worst = F.greatest(*devs, F.lit(0.0))
    status = F.when(~ready, "baseline_building").when((signals > 0) & (worst >= 5), "critical_change").when(signals > 0, "changed").otherwise("stable")
    return s.select(*runs.columns, F.when(ready, score).alias("change_score"), F.when(ready, signals).alias("signals"), status.alias("change_status"))


def rule_matches(values: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule_id, severity, value) of every rule that holds. values: (key, metric, value); rules: (rule_id, metric, operator, threshold, severity, enabled)."""
    v, t = F.col("value"), F.col("threshold")
    holds = F.when(F.col("operator") == ">=", v >= t).when(F.col("operator") == ">", v > t).when(F.col("operator") == "<=", v <= t).when(F.col("operator") == "<", v < t)
    return values.join(rules.where("enabled"), "metric").where(holds).select(key, "rule_id", "severity", "value")


def merge_incidents(state: DataFrame, matches: DataFrame, evaluated: DataFrame, run: Column) -> DataFrame:
    """Next state of incidents keyed by fingerprint (key:rule), by one full outer join of the state and this run's matches.

    A matched open incident counts one more and takes the higher severity (escalated if higher); a resolved one reopens under
    the same fingerprint; an open one is resolved only if its key was evaluated in this run and did not match.
    state: (fingerprint, key, rule_id, severity, status, occurrences, run); matches: (key, rule_id, severity); evaluated: (key).
    """
    m = matches.groupBy("key", "rule_id").agg(F.max_by("severity", F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), F.col("severity"))).alias("m_sev"))
    m = m.select(F.concat_ws(":", "key", "rule_id").alias("fingerprint"), F.col("key").alias("m_key"), F.col("rule_id").alias("m_rule"), "m_sev")
    s = state.join(m, "fingerprint", "full").withColumn("__k", F.coalesce("key", "m_key")).join(evaluated.select(F.col("key").alias("__k"), F.lit(True).alias("__e")).distinct(), "__k", "left")
    rank = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), F.col(c)), F.lit(0))
    hit, old = F.col("m_sev").isNotNull(), F.col("status").isNotNull()
    higher = rank("m_sev") > rank("severity")
    status = F.when(hit & ~old, "open").when(hit & (F.col("status") == "resolved"), "reopened").when(hit & higher, "escalated").when(hit, F.col("status")).when(F.col("__e") & (F.col("status") != "resolved"), "resolved").otherwise(F.col("status"))
    return s.select("fingerprint", F.coalesce("key", "m_key").alias("key"), F.coalesce("rule_id", "m_rule").alias("rule_id"), F.when(hit & (higher | ~old), F.col("m_sev")).otherwise(F.col("severity")).alias("severity"), status.alias("status"), (F.coalesce("occurrences", F.lit(0)) + F.when(hit, 1).otherwise(0)).alias("occurrences"), F.when(hit, run).otherwise(F.col("run")).alias("run"))


def drift(runs: DataFrame, key: str, order: str, rates: list[str], history: int = 10, robust: bool = False) -> DataFrame:
    """Signature of each run against the runs before it: mean and mean absolute deviation (median and MAD if ``robust``), signals at 3.5, building below 3 runs."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(-history, -1)
    s = runs.withColumn("__k", F.count("*").over(before))
    marks = []
    for c in rates:
        mid = quantile(F.col(c), 0.5).over(before) if robust else F.avg(c).over(before)
        s = s.withColumn(f"__m_{c}", mid).withColumn(f"__p_{c}", F.collect_list(c).over(before))
        n = F.greatest(F.size(f"__p_{c}"), F.lit(1))
        dev = F.transform(f"__p_{c}", _away(f"__m_{c}"))
        spread = (F.try_element_at(F.array_sort(dev), F.floor(n / 2).cast("int") + 1)) if robust else F.aggregate(dev, F.lit(0.0), lambda a, x: a + x) / n
        s = s.withColumn(f"__z_{c}", F.abs(F.col(c) - F.col(f"__m_{c}")) / F.greatest(spread, 0.10 * F.abs(F.col(f"__m_{c}")), F.lit(1e-6)))
        marks.append(F.coalesce(F.col(f"__z_{c}") >= 3.5, F.lit(False)).cast("int"))
    signals = reduce(lambda a, b: a + b, marks)
    status = F.when(F.col("__k") < 3, "baseline_building").when(signals > 0, "drift").otherwise("stable")
    return s.select(*runs.columns, F.when(F.col("__k") >= 3, signals).otherwise(F.lit(0)).alias("signals"), status.alias("drift_status"))


def risk(terms: dict[str, float]) -> Column:
    """struct(score, band) of clipped terms with weights that sum to 1; bands at .7 and .4."""
    if abs(sum(terms.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    score = reduce(lambda a, b: a + b, [F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * w for c, w in terms.items()])
    return F.struct(score.alias("score"), F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low").alias("band"))


def cases(incidents: DataFrame, management: DataFrame, notes: DataFrame, objects: DataFrame) -> DataFrame:
    """One row per incident with the last row of its management, its notes counted and the last version of its object.

    incidents: (incident_id, object_key, rec, ..); management: (incident_id, rec, ..); notes: (incident_id, id); objects:
    (object_key, version, name, status). Repeated rows count once; incidents without any of these keep NULLs. An object with a
    large share of the incidents is spread.
    """
    own = latest(incidents, ["incident_id"], "rec").drop("rec")
    led = latest(management.where("incident_id is not null"), ["incident_id"], "rec").drop("rec")
    told = notes.where("incident_id is not null").select("incident_id", "id").distinct().groupBy("incident_id").agg(F.count("*").alias("n_notes"))
    last = objects.where("object_key is not null").groupBy("object_key").agg(F.max_by(F.struct("version", "name", F.col("status").alias("object_status")), "version").alias("o")).select("object_key", "o.*")
    both = own.join(led, "incident_id", "left").join(told, "incident_id", "left").fillna(0, ["n_notes"])
    return skew_join(both, last, ["object_key"], "left", F.col("incident_id"))


def dashboard(monitoring: DataFrame, alerts: DataFrame, least: int = 3) -> DataFrame:
    """(object_key, runs, last_us, last_status, alerts, baseline_state) of every object with runs. Both: (object_key, id, at_us, status); repeated rows count once."""
    runs = monitoring.where("object_key is not null").distinct().groupBy("object_key").agg(F.count("*").alias("runs"), F.max("at_us").alias("last_us"), F.max_by("status", F.struct("at_us", "id")).alias("last_status"))
    raised = alerts.where("object_key is not null").select("object_key", "id").distinct().groupBy("object_key").agg(F.count("*").alias("alerts"))
    state = F.when(F.col("runs") >= least, "ready").otherwise("building").alias("baseline_state")
    return runs.join(raised, "object_key", "left").fillna(0, ["alerts"]).select("object_key", "runs", "last_us", "last_status", "alerts", state)


def operations(incidents: DataFrame) -> DataFrame:
    """(status, severity, incidents, occurrences) of the last row of each incident. incidents: (incident_id, rec, status, severity, occurrences)."""
    return latest(incidents, ["incident_id"], "rec").groupBy("status", "severity").agg(F.count("*").alias("incidents"), F.sum("occurrences").alias("occurrences"))


# Severity, kind, measure and least value of the findings over a territory and over a whole analysis.
TERRITORY_RULES = (("critical", "critical_concentration", "critical_99", 1.0), ("high", "spatial_signal", "mean_spatial", 0.75), ("high", "temporal_signal", "mean_temporal", 0.75))
ANALYSIS_RULES = (("critical", "statistical", "critical_99", 1.0), ("high", "spatial", "hotspots", 1.0), ("elevated", "spatial", "clusters", 1.0), ("elevated", "temporal", "change_points", 1.0))


def findings(summary: DataFrame, key: str, rules: tuple[tuple[str, str, str, float], ...] = TERRITORY_RULES) -> DataFrame:
    """(key, severity, type, measure, value) of every rule whose measure reaches its least value; NULLs find nothing."""
    cells = [F.when(F.col(c) >= least, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))) for severity, kind, c, least in rules]
    return summary.select(key, F.inline(F.array_compact(F.array(*cells))))
