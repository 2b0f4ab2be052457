"""File sources: a directory of mixed point tables becomes one DataFrame of observations with lineage.

CSV, JSON, GeoJSON, Parquet and GeoParquet are read by Spark's own readers. Excel, GeoPackage and shapefiles come through
``binaryFile`` and are parsed file by file in ``mapInPandas``, so each file is one unit of work on some executor.
"""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions.geo import in_ring
from terravane.operators.cleaning import union_sources

# Suffixes that are read, and names under which coordinates are found.
SUFFIXES = (".csv", ".json", ".geojson", ".parquet", ".geoparquet", ".xlsx", ".gpkg", ".shp")
LAT_NAMES = ("latitude", "lat", "latitud", "y")
LON_NAMES = ("longitude", "lon", "lng", "long", "longitud", "x")
ROW = "path string, properties map<string,string>, lon double, lat double, geometry string"
Place = tuple[float | None, float | None, str | None]  # lon and lat of a point, and the geometry as well-known text


def coordinate_columns(columns: list[str]) -> tuple[str, str] | None:
    """The latitude and longitude column, by name, whatever the case."""
    low = {c.strip().lower(): c for c in columns}
    lat, lon = next((low[n] for n in LAT_NAMES if n in low), None), next((low[n] for n in LON_NAMES if n in low), None)
    return (lat, lon) if lat and lon else None


def as_points(df: DataFrame) -> DataFrame:
    """Adds lon and lat as doubles and keeps rows on the globe; a table without coordinates is an error."""
    found = coordinate_columns(df.columns)
    if not found:
        raise ValueError("no latitude and longitude columns")
    lat, lon = (F.col(f"`{c}`").try_cast("double") for c in found)
    out = df.drop(*[c for c in df.columns if c.lower() in ("lat", "lon") and c not in found]).withColumns({"__lat": lat, "__lon": lon}).where(F.col("__lon").between(-180.0, 180.0) & F.col("__lat").between(-90.0, 90.0))
    return out.drop(*[c for c in out.columns if c.lower() in ("lat", "lon")]).withColumnsRenamed({"__lat": "lat", "__lon": "lon"})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, recursiveFileLookup=True)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features as rows: properties and the point; other shapes have NULL coordinates and keep their text."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    shape = "struct<features:array<struct<properties:map<string,string>,geometry:string>>>"
    rows = text.select("path", F.explode(F.from_json("value", shape)["features"]).alias("f"))
    xy = F.from_json(F.get_json_object("f.geometry", "$.coordinates"), "array<double>")
    is_point = F.get_json_object("f.geometry", "$.type") == "Point"
    return rows.select("path", F.col("f.properties").alias("properties"), F.when(is_point, xy[0]).alias("lon"), F.when(is_point, xy[1]).alias("lat"), F.col("f.geometry").alias("geometry"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON if the text holds features, else a table of records."""
    df = spark.read.json(path, multiLine=True, recursiveFileLookup=True)
    return read_geojson(spark, path) if "features" in df.columns else df


def wkb_point(c: Column) -> Column:
    """struct(lon, lat, wkt) of WKB of either byte order; lon and lat of points only."""

    @F.pandas_udf("lon double, lat double, wkt string")
    def parse(b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wkb_place(x) for x in b], columns=["lon", "lat", "wkt"])

    return parse(c)


_KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}


def _ring_text(xy: list[tuple[float, float]]) -> str:
    return "(" + ", ".join(f"{x!r} {y!r}" for x, y in xy) + ")"


def _wkb(b: bytes, at: int) -> tuple[str, str, int]:
    """(kind, text behind the kind, end) of the geometry that begins at ``at``; heights and measures are passed over."""
    order = "<" if b[at] == 1 else ">"
    code = struct.unpack_from(order + "I", b, at + 1)[0]
    at += 9 if code & 0x20000000 else 5
    kind = code & 0xFF if code > 0xFFFF else code % 1000
    width = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) if code > 0xFFFF else 2 + (code // 1000 in (1, 3)) + (code // 1000 in (2, 3))

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", b, at - 4)[0]

    def positions(n: int) -> list[tuple[float, float]]:
        nonlocal at
        flat = struct.unpack_from(f"{order}{n * width}d", b, at)
        at += 8 * n * width
        return [(flat[i], flat[i + 1]) for i in range(0, len(flat), width)]

    if kind == 1:
        text = _ring_text(positions(1))
    elif kind == 2:
        text = _ring_text(positions(number()))
    elif kind == 3:
        text = "(" + ", ".join(_ring_text(positions(number())) for _ in range(number())) + ")"
    else:
        parts = []
        for _ in range(number()):
            _, part, at = _wkb(b, at)
            parts.append(part)
        text = "(" + ", ".join(parts) + ")"
    return _KINDS[kind], text, at


def wkb_place(b: bytes | None) -> Place:
    """NULL, empty and unreadable bytes give NULLs."""
    try:
        kind, text, _ = _wkb(bytes(b), 0) if b is not None and len(b) > 4 else ("", "", 0)
    except (struct.error, KeyError, IndexError):
        return None, None, None
    if not kind:
        return None, None, None
    x, y = (float(v) for v in text[1:-1].split()) if kind == "POINT" else (None, None)
    return (None, None, None) if x is not None and (x != x or y != y) else (x, y, f"{kind} {text}")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet; a binary ``geometry`` column is read as WKB: lon and lat of points, and ``geometry_wkt`` of all shapes."""
    df = spark.read.parquet(path)
    if dict(df.dtypes).get("geometry") == "binary":
        df = df.withColumn("__p", wkb_point(F.col("geometry"))).select(*[c for c in df.columns if c not in ("lon", "lat", "geometry_wkt")], "__p.lon", "__p.lat", F.col("__p.wkt").alias("geometry_wkt"))
    return df


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _rows(path: str, records: list[dict], places: list[Place] | None = None) -> pd.DataFrame:
    props = [{str(k): None if v is None else str(v) for k, v in r.items()} for r in records]
    if places is None:
        found = coordinate_columns(list(records[0])) if records else None
        pick = lambda r, c: pd.to_numeric(r.get(c), errors="coerce") if found else None
        places = [(pick(r, found[1]) if found else None, pick(r, found[0]) if found else None, None) for r in records]
    number = lambda v: float(v) if v is not None else None
    return pd.DataFrame({"path": [path] * len(props), "properties": props, "lon": [number(x) for x, _, _ in places], "lat": [number(y) for _, y, _ in places], "geometry": [g for _, _, g in places]})


def parse_xlsx(content: bytes) -> list[dict]:
    """First sheet, first row as names."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]
        table: list[dict[str, str | None]] = []
        for row in ET.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
            cells: dict[str, str | None] = {}
            for c in row.findall("m:c", ns):
                col = "".join(ch for ch in c.get("r", "") if ch.isalpha())
                v = c.find("m:v", ns)
                inline = c.find("m:is/m:t", ns)
                cells[col] = shared[int(v.text)] if v is not None and c.get("t") == "s" else v.text if v is not None else inline.text if inline is not None else None
            table.append(cells)
    if not table:
        return []
    names = table[0]
    return [{n: row.get(col) for col, n in names.items() if n} for row in table[1:]]


def parse_gpkg(content: bytes) -> tuple[list[dict], list[Place]]:
    """First feature table, read in memory; its geometry is WKB behind a header whose envelope size stands in the flags."""
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    con.row_factory = sqlite3.Row
    name, geom = con.execute("select table_name, column_name from gpkg_geometry_columns limit 1").fetchone()
    rows = con.execute(f'select * from "{name}"').fetchall()
    con.close()
    records, places = [], []
    for r in rows:
        b = r[geom]
        skip = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}.get((b[3] >> 1) & 7, 0) if b else 0
        places.append(wkb_place(b[skip:] if b else None))
        records.append({k: r[k] for k in r.keys() if k != geom})
    return records, places


def _shp_place(body: bytes) -> Place:
    """One record: points, lines, areas and sets of points, also with heights or measures, which are passed over."""
    kind = struct.unpack_from("<i", body)[0] % 10
    if kind == 1:
        x, y = struct.unpack_from("<dd", body, 4)
        return x, y, f"POINT {_ring_text([(x, y)])}"
    if kind == 8:
        n = struct.unpack_from("<i", body, 36)[0]
        flat = struct.unpack_from(f"<{2 * n}d", body, 40)
        return None, None, "MULTIPOINT (" + ", ".join(_ring_text([p]) for p in zip(flat[::2], flat[1::2])) + ")"
    if kind not in (3, 5):
        return None, None, None
    parts, n = struct.unpack_from("<ii", body, 36)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * parts)
    xy = list(zip(flat[::2], flat[1::2]))
    rings = [xy[a:b] for a, b in zip(starts[:-1], starts[1:])]
    if kind == 3:
        return None, None, "MULTILINESTRING (" + ", ".join(map(_ring_text, rings)) + ")"
    # outer rings run clockwise; a hole belongs to the first outer ring around it
    turn = lambda r: sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1]))
    outer = [[r] for r in rings if turn(r) <= 0] or [[r] for r in rings]
    for hole in (r for r in rings if turn(r) > 0 and [r] not in outer):
        x, y = np.array([hole[0][0]]), np.array([hole[0][1]])
        next((p for p in outer if any(m[0] for m in in_ring(x, y, np.array(p[0])))), outer[0]).append(hole)
    return None, None, "MULTIPOLYGON (" + ", ".join("(" + ", ".join(map(_ring_text, p)) + ")" for p in outer) + ")"


def parse_shp(shp: bytes, dbf: bytes) -> tuple[list[dict], list[Place]]:
    """Records of a shapefile and their attributes."""
    places, at = [], 100
    while at + 8 <= len(shp):
        size = struct.unpack(">i", shp[at + 4 : at + 8])[0] * 2
        places.append(_shp_place(shp[at + 8 : at + 8 + size]))
        at += 8 + size
    count, head, width = struct.unpack("<IHH", dbf[4:12])
    fields, pos = [], 32
    while dbf[pos] != 0x0D:
        fields.append((dbf[pos : pos + 11].split(b"\0")[0].decode("latin-1"), dbf[pos + 16]))
        pos += 32
    records = []
    for i in range(count):
        at, rec = head + i * width + 1, {}
        for n, w in fields:
            rec[n] = dbf[at : at + w].decode("latin-1").strip() or None
            at += w
        records.append(rec)
    return records, places


def safe_members(z: zipfile.ZipFile) -> list[str]:
    """Names of a ZIP that stay inside their folder; an entry that leads out of it is an error."""
    for n in z.namelist():
        p = PurePosixPath(n.replace("\\", "/"))
        if p.is_absolute() or ".." in p.parts:
            raise ValueError(f"unsafe path in archive: {n}")
    return z.namelist()


def parse_shp_zip(content: bytes) -> tuple[list[dict], list[Place]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        by = {PurePosixPath(n).suffix.lower(): n for n in safe_members(z)}
        if not {".shp", ".dbf", ".shx"} <= set(by):
            raise ValueError("a shapefile archive needs .shp, .dbf and .shx")
        return parse_shp(z.read(by[".shp"]), z.read(by[".dbf"]))


def _parsed(files: DataFrame, parse) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                got = parse(content)
                yield _rows(path, *got) if isinstance(got, tuple) else _rows(path, got)

    return files.mapInPandas(run, ROW)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(_files(spark, path, ".xlsx"), parse_xlsx)


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(_files(spark, path, ".gpkg"), parse_gpkg)


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """ZIP archives with .shp, .dbf and .shx."""
    return _parsed(_files(spark, path, ".zip"), parse_shp_zip)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the readable files under a folder, in no order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1))
    return files.where(suffix.isin(*SUFFIXES)).select("path", "length", F.sha2("content", 256).alias("sha256"))


def append(parts: dict[str, DataFrame]) -> DataFrame:
    """Sources by name under the union of their columns."""
    return union_sources(list(parts.values()), list(parts))


def feature_text(df: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row."""
    f = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(f).alias("feature"))


def collection(features: list[str]) -> str:
    return json.dumps({"type": "FeatureCollection", "features": [json.loads(f) for f in features]})
