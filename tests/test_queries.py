from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = Path("/root/testdata/sf0.001")
CHECKED = ["p1_found", "p1_counts", "p3_found", "p4_found", "scale_robust", "pct_rank", "quality_metrics", "region_compare_mw", "region_compare_ks", "rolling_mad", "euclidean_intelligence", "temporal_profile", "trajectory", "monitoring_change", "alert_incidents", "indices", "histogram80", "ensemble_flags"]
CHECKED += ["p1_inherited", "p4_as_of", "p5_range_and_run", "spatial_predicates", "spatial_left_join", "overlay_difference", "overlay_strip", "corridor_buffers", "repaired_rings", "spatial_score", "temporal_deviation"]
CHECKED += ["incident_cases", "monitoring_dashboard", "enrichment_plan", "raster_window", "trajectory_watch", "procrustes_score", "score_transfer", "utm_points", "metric_buffer"]


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, np.generic):
        return v.item()
    return v


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for p in DIR.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    got = rows(entry.queries()[name](spark, str(DIR)).toPandas())
    assert got == rows(con.execute(entry.oracle_sql()[name]).df())


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80


def test_entry(spark):
    assert entry.entry(spark).count() > 0
