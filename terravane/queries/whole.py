"""The whole analysis over the fire points."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.common import table
from terravane.functions.geo import with_position
from terravane.functions.stats import finite
from terravane.operators.spikes import minute_of_day
from terravane.plans import analysis, export
from terravane.queries.registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql
PERMUTATIONS = 199  # as the reference, whatever the size


def analyzed(spark, d):
    t = table(spark, d, "fire_points")
    keep = [F.col("row_id").alias("id"), F.col("_source_file").alias("source"), F.datediff("ACQ_DATE", F.lit("1970-01-01")).alias("day"), minute_of_day(F.col("ACQ_TIME")).alias("minute"), "BRIGHTNESS", "BRIGHT_T31", "FRP", "SCAN", "TRACK"]
    rows = with_position(t, keep, F.col("lat"), F.col("lon"), F.col("geometry"))
    return analysis.analyze(rows, ["BRIGHTNESS", "BRIGHT_T31", "FRP", "SCAN", "TRACK"], "FRP", "source", ["day", "minute"], permutations=PERMUTATIONS)


@R.add()
def fire_analysis(spark, d):
    cols = ["id", "outlier_score", "outlier_level", "consensus_methods", "anomaly_reason", "record_status", "lisa_cluster", "density_rank", "tail_area", "distribution"]
    return analyzed(spark, d).select(*cols)


@R.add("""with s as (select outlier_score as v from fire_points where not isnan(outlier_score) and outlier_score is not null), q as (select quantile_cont(v, [0.25, 0.75]) as q, count(*) as n, min(v) as a, max(v) as b from s),
w as (select greatest(2 * (q[2] - q[1]) / cbrt(n), (b - a) / 200, 1e-12) as w, a from q) select floor((v - a) / w)::bigint as bin, count(*) as n, min(v) as low from s, w group by 1""")
def display_histogram(spark, d):
    t = table(spark, d, "fire_points").select(finite(F.col("outlier_score")).alias("v"))
    return export.display_histogram(t, "v")
