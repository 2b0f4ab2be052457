"""Queries of the general data problems over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.common import instant_us, object_key, plain_status, table
from terravane.functions.geo import with_position
from terravane.operators import history, nearby, orphans, spikes


def object_versions(log: DataFrame) -> DataFrame:
    attributes = {"name": F.col("name"), "object_type": F.col("object_type"), "status": plain_status(F.col("status"))}
    return history.effective_versions(log, object_key(F.col("object_key")), F.col("version"), instant_us(F.col("created_at")), attributes, (F.col("recorded_at"), F.col("id")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = history.validity(history.encode(object_versions(table(spark, sf_dir, "territorial_objects"))))
    return periods.select(F.col("key").alias("object_key"), "version", "valid_from_us", "valid_to_us")


AS_OF_US = 1_730_000_000_000_000


def p4_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes of every object at one instant."""
    told = history.as_of(history.encode(object_versions(table(spark, sf_dir, "territorial_objects"))), AS_OF_US)
    return told.select(F.col("key").alias("object_key"), "state.name", "state.object_type", "state.status")


def reference_graph(spark: SparkSession, sf_dir: str) -> orphans.Graph:
    """Notes and management rows refer to incidents; incidents, alerts and monitoring rows refer to objects."""
    t = lambda name: table(spark, sf_dir, name)

    def rows(name: str, row_key: str, at: str, pk: str | None, ref) -> DataFrame:
        return t(name).select(F.col(row_key).alias("row_key"), instant_us(F.col(at)).alias("at_us"), F.col("recorded_at").alias("rec"), (F.col(pk).cast("string") if pk else F.lit(None).cast("string")).alias("pk"), ref.alias("ref"))

    incident, key = F.col("incident_id").cast("string"), object_key(F.col("object_key"))
    nodes = [
        orphans.Node("incident_management", rows("incident_management", "incident_id", "updated_at", None, incident), "alert_incidents"),
        orphans.Node("incident_notes", rows("incident_notes", "id", "created_at", None, incident), "alert_incidents"),
        orphans.Node("alert_incidents", rows("alert_incidents", "id", "opened_at", "id", key), "territorial_objects"),
        orphans.Node("territorial_alerts", rows("territorial_alerts", "id", "created_at", None, key), "territorial_objects"),
        orphans.Node("territorial_monitoring", rows("territorial_monitoring", "id", "created_at", None, key), "territorial_objects"),
    ]
    log, incidents = t("territorial_objects"), t("alert_incidents")
    periods = history.validity(history.encode(object_versions(log))).where(F.col("state.status") == "deleted")
    objects = orphans.Parent(
        log.select(object_key(F.col("object_key")).alias("key"), F.col("recorded_at").alias("rec")),
        periods.select("key", F.col("valid_from_us").alias("from_us"), F.when(F.col("valid_to_us") >= 0, F.col("valid_to_us")).alias("to_us")),
    )
    erased = incidents.select(F.col("id").cast("string").alias("key"), instant_us(F.col("deleted_at")).alias("from_us")).where("from_us is not null").groupBy("key").agg(F.min("from_us").alias("from_us"))
    cases = orphans.Parent(incidents.select(F.col("id").cast("string").alias("key"), F.col("recorded_at").alias("rec")), erased.withColumn("to_us", F.lit(None).cast("long")))
    return orphans.Graph({n.name: n for n in nodes}, {"territorial_objects": objects, "alert_incidents": cases})


REPORTED = ("incident_management", "incident_notes", "territorial_alerts", "territorial_monitoring")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphans.find(reference_graph(spark, sf_dir))
    return found.where((F.col("kind") == "direct") & F.col("table_name").isin(*REPORTED)).select("table_name", "period", "row_key", "reason")


def p1_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose reference holds, but leads to an orphan."""
    return orphans.find(reference_graph(spark, sf_dir)).where("kind = 'inherited'").select("table_name", "period", "row_key", "level", "via")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.counts(orphans.find(reference_graph(spark, sf_dir)))


QUERIES = {"p1_found": p1_found, "p1_inherited": p1_inherited, "p1_counts": p1_counts, "p4_found": p4_found, "p4_as_of": p4_as_of}
SQL: dict[str, str] = {}

_KEY = r"nullif(regexp_replace(lower(object_key), '^[\s-]+|[\s-]+$|-', '', 'g'), '')"


def _us(column: str) -> str:
    return f"epoch_us(try_cast({column} as timestamptz))"


PERIODS_SQL = rf"""
rowed as (select {_KEY} as key, version, name, object_type, lower(trim(status)) as status, {_us('created_at')} as start_us, recorded_at, id from territorial_objects),
last_rows as (select * from rowed where key is not null and version is not null and start_us is not null
  qualify row_number() over (partition by key, version order by recorded_at desc nulls last, id desc) = 1),
instants as (select * from last_rows qualify row_number() over (partition by key, start_us order by version desc) = 1),
lagged as (select *, row_number() over w as nth, lag(name) over w as n0, lag(object_type) over w as t0, lag(status) over w as s0 from instants window w as (partition by key order by start_us)),
opened as (select * from lagged where nth = 1 or name is distinct from n0 or object_type is distinct from t0 or status is distinct from s0),
periods as (select key, version, status, start_us as from_us, coalesce(lead(start_us) over (partition by key order by start_us), -1) as to_us from opened)
"""
SQL["p4_found"] = f"with {PERIODS_SQL} select key as object_key, version::bigint as version, from_us as valid_from_us, to_us as valid_to_us from periods"
SQL["p4_as_of"] = f"with {PERIODS_SQL} select key as object_key, name, object_type, status from instants where start_us <= {AS_OF_US} qualify row_number() over (partition by key order by start_us desc) = 1"
_REFERENCES = rf"""
objects as (select {_KEY} as key, min(recorded_at) as rec from territorial_objects group by 1),
cases as (select id as key, min(recorded_at) as rec, min({_us('deleted_at')}) as gone from alert_incidents group by 1),
to_cases as (
  select 'incident_management' as table_name, incident_id as row_key, incident_id as key, {_us('updated_at')} as at_us, recorded_at as rec from incident_management
  union select 'incident_notes', id, incident_id, {_us('created_at')}, recorded_at from incident_notes),
to_objects as (
  select 'territorial_alerts' as table_name, id as row_key, {_KEY} as key, {_us('created_at')} as at_us, recorded_at as rec from territorial_alerts
  union select 'territorial_monitoring', id, {_KEY}, {_us('created_at')}, recorded_at from territorial_monitoring
  union select 'alert_incidents', id, {_KEY}, {_us('opened_at')}, recorded_at from alert_incidents),
judged as (
  select table_name, row_key, r.key::varchar as key, at_us, case when c.key is null then 'missing' when r.rec < c.rec then 'late' when at_us >= c.gone then 'deleted' end as reason
  from to_cases r left join cases c on r.key = c.key where r.key is not null
  union
  select table_name, row_key, r.key, at_us, case when o.key is null then 'missing' when r.rec < o.rec then 'late' when p.key is not null then 'deleted' end
  from to_objects r left join objects o on r.key = o.key
  left join periods p on p.key = r.key and p.status = 'deleted' and at_us >= p.from_us and (p.to_us < 0 or at_us < p.to_us) where r.key is not null)
"""
_MONTH = "strftime(make_timestamp(at_us), '%Y-%m')"
SQL["p1_found"] = f"with {PERIODS_SQL}, {_REFERENCES} select distinct table_name, {_MONTH} as period, row_key, reason from judged where reason is not null and table_name <> 'alert_incidents'"
_BAD = "bad as (select distinct row_key::varchar as key from judged where table_name = 'alert_incidents' and reason is not null)"
SQL["p1_inherited"] = f"""with {PERIODS_SQL}, {_REFERENCES}, {_BAD}
select distinct table_name, {_MONTH} as period, row_key, 1 as level, 'alert_incidents' as via from judged j join bad b on j.key = b.key where j.reason is null and table_name in ('incident_management', 'incident_notes')"""
SQL["p1_counts"] = f"""with {PERIODS_SQL}, {_REFERENCES}, {_BAD},
listed as (select distinct table_name, {_MONTH} as period, row_key, reason, 'direct' as kind from judged where reason is not null
  union select table_name, {_MONTH}, row_key, 'inherited', 'inherited' from judged j join bad b on j.key = b.key where j.reason is null and table_name in ('incident_management', 'incident_notes'))
select table_name, period, reason, kind, count(*) as n_rows from listed group by all"""

NEAR_M = 150.0


def fire_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(table(spark, sf_dir, "fire_points"), [F.col("row_id").alias("id")], F.col("lat"), F.col("lon"), F.col("geometry"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fire_positions(spark, sf_dir)
    layers = table(spark, sf_dir, "layers").select(F.col("id").alias("region_id"), F.col("geometry_json").alias("geojson"))
    near = nearby.near_pairs(points, NEAR_M, at_most=table(spark, sf_dir, "fire_points").count()).select(F.lit("near").alias("relation"), "key_a", "key_b")
    return near.unionByName(nearby.containing(points, layers).select(F.lit("inside").alias("relation"), "key_a", "key_b"))


QUERIES["p3_found"] = p3_found
_N = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
_USABLE = "{0} between -90 and 90 and {1} between -180 and 180 and not isnan({0}) and not isnan({1}) and not ({0} = 0 and {1} = 0)"
SQL["p3_found"] = rf"""with told as (select row_id, lat, lon,
  try_cast(regexp_extract(geometry, '(?i)(?:point\s*z?\s*\(|coordinates"\s*:\s*\[)\s*{_N}[\s,]+{_N}', 1) as double) as gx,
  try_cast(regexp_extract(geometry, '(?i)(?:point\s*z?\s*\(|coordinates"\s*:\s*\[)\s*{_N}[\s,]+{_N}', 2) as double) as gy from fire_points),
placed as (select row_id, case when {_USABLE.format('lat', 'lon')} then lat else gy end as y, case when {_USABLE.format('lat', 'lon')} then lon else gx end as x
  from told where ({_USABLE.format('lat', 'lon')}) or ({_USABLE.format('gy', 'gx')})),
celled as (select *, floor(y / 0.002)::int as cy, floor(x / 0.02)::int as cx from placed),
around as (select row_id, y, x, cy + dy as cy, cx + dx as cx from celled, unnest([-1, 0, 1]) as s(dy), unnest([-1, 0, 1]) as u(dx)),
near as (select a.row_id as key_a, b.row_id as key_b from celled a join around b on a.cy = b.cy and a.cx = b.cx and a.row_id < b.row_id
  where 2e0 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 150e0),
parts as (select id, unnest(case when geometry_json->>'type' = 'MultiPolygon' then from_json(geometry_json->'coordinates', '["JSON"]') else [geometry_json->'coordinates'] end) as poly from layers),
numbered as (select id, row_number() over () as part, poly from parts where json_array_length(poly) > 0),
rings as (select id, part, unnest(from_json(poly, '[[["DOUBLE"]]]')) as ring, generate_subscripts(from_json(poly, '[[["DOUBLE"]]]'), 1) as nth from numbered),
edges as (select id, part, nth, ring[k][1] as ax, ring[k][2] as ay, ring[k % len(ring) + 1][1] as bx, ring[k % len(ring) + 1][2] as by from (select *, unnest(range(1, len(ring) + 1)) as k from rings)),
boxes as (select id, part, min(ax) as x0, max(ax) as x1, min(ay) as y0, max(ay) as y1 from edges where nth = 1 group by 1, 2),
crossed as (select p.row_id, e.id, e.part, e.nth, sum(case when (e.ay > p.y) <> (e.by > p.y) and p.x < (e.bx - e.ax) * (p.y - e.ay) / (e.by - e.ay) + e.ax then 1 else 0 end) % 2 as odd
  from placed p join boxes b on p.x between b.x0 and b.x1 and p.y between b.y0 and b.y1 join edges e on e.id = b.id and e.part = b.part group by all),
held as (select distinct row_id, id from (select row_id, id, part from crossed group by all having max(case when nth = 1 then odd else 0 end) = 1 and max(case when nth > 1 then odd else 0 end) = 0))
select 'near' as relation, key_a, key_b from near union all select 'inside', row_id, id from held"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flag(table(spark, sf_dir, "fire_points"), table(spark, sf_dir, "field_limits"))


QUERIES["p5_found"] = p5_found


def p5_range_and_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range and run checks alone."""
    return spikes.flag(table(spark, sf_dir, "fire_points"), table(spark, sf_dir, "field_limits"), spikes=False)


QUERIES["p5_range_and_run"] = p5_range_and_run
_MINUTE = r"case when regexp_matches(ACQ_TIME, '^\s*\d{1,4}(?:\.0*)?\s*$') then regexp_extract(ACQ_TIME, '(\d+)', 1)::int end"
SQL["p5_range_and_run"] = rf"""with told as (select *, {_MINUTE} as hhmm from fire_points),
timed as (select * exclude (hhmm), case when hhmm % 100 < 60 and hhmm < 2400 then hhmm // 100 * 60 + hhmm % 100 else -1 end as minute from told),
once as (select min(row_id) as rid, list(row_id) as copies, any_value(minute) as m, * exclude (row_id, received_at, minute) from timed group by all),
long as (select rid, copies, _source_file, _api_source, ACQ_DATE, m, u.field as field_name, u.v from once, lateral (select unnest([{{'field': 'FRP', 'v': FRP}}, {{'field': 'BRIGHTNESS', 'v': BRIGHTNESS}}, {{'field': 'BRIGHT_T31', 'v': BRIGHT_T31}}]) as u) where u.v is not null and not isnan(u.v)),
placed as (select *, row_number() over w as i, case when lag(v) over w is not distinct from v then 0 else 1 end as new from long window w as (partition by _source_file, field_name order by ACQ_DATE nulls first, m, rid)),
grouped as (select *, sum(new) over (partition by _source_file, field_name order by i) as run from placed),
sized as (select *, count(*) over (partition by _source_file, field_name, run) as n from grouped)
select unnest(copies) as row_id, s.field_name from sized s left join field_limits l on l.api_source = s._api_source and l.field_name = s.field_name where n >= 12 or isinf(v) or v < low_value or v > high_value"""
