"""Readers for incident/call tables, GeoJSON, WKT-in-CSV, GraphML, edge
lists and folders of per-jurisdiction files.

CSV inputs are read with every column as a string (no schema inference:
inference turns tower ids such as ``T01`` into timestamps); the
normalisers in :mod:`vigila.operators.normalize` then map aliases and
parse types with ``try_cast`` / ``try_to_timestamp`` so that bad values
become null instead of failing the job.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare

# Column names that mark a table as incidents or as calls.
INCIDENT_MARKERS = ("fir_id", "crime_type", "accused", "offence")
CALL_MARKERS = ("caller_id", "receiver_id", "start_time", "cdr_id")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("mode", "PERMISSIVE").csv(path))


def read_incidents_csv(spark: SparkSession, path: str) -> DataFrame:
    """Incident CSV with header, all columns as strings."""
    return _csv(spark, path)


def read_calls_csv(spark: SparkSession, path: str) -> DataFrame:
    """R2: call-record CSV with header, all columns as strings."""
    return _csv(spark, path)


def read_devices_csv(spark: SparkSession, path: str) -> DataFrame:
    """Device map: imei, phone_number, first_seen, last_seen."""
    return _csv(spark, path)


def read_locations_csv(spark: SparkSession, path: str) -> DataFrame:
    """Locations: loc_id, latitude, longitude, name, type."""
    return _csv(spark, path)


# ---------------------------------------------------------------- GeoJSON

_FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),
    ])),
])
_COLLECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(_FEATURE)),
])

_XY = T.ArrayType(T.DoubleType())


def _geometry_columns(feat) -> list:
    """Parse GeoJSON coordinates by geometry type into
    ``geom_type``, ``lon``/``lat`` (points) and ``rings`` (polygons, lon/lat)."""
    gtype = feat["geometry"]["type"]
    coords = feat["geometry"]["coordinates"]
    pt = F.from_json(coords, _XY)
    poly = F.from_json(coords, T.ArrayType(T.ArrayType(_XY)))
    multi = F.from_json(coords, T.ArrayType(T.ArrayType(T.ArrayType(_XY))))

    def to_rings(p):
        return F.transform(p, lambda ring: F.transform(
            ring, lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))))

    rings = (F.when(gtype == "Polygon", to_rings(poly))
              .when(gtype == "MultiPolygon", to_rings(F.flatten(multi))))
    return [gtype.alias("geom_type"),
            F.when(gtype == "Point", pt[0]).alias("lon"),
            F.when(gtype == "Point", pt[1]).alias("lat"),
            rings.alias("rings")]


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON FeatureCollection files -> one row per feature with a
    ``properties`` map, parsed geometry columns and ``file_name``.

    A FeatureCollection is one JSON document, so each file is parsed by a
    single task; for large layers use line-delimited GeoJSONSeq with
    :func:`read_geojson_seq`, which splits like any text file.
    """
    prepare(spark)
    raw = spark.read.option("wholetext", True).text(path) \
        .select("value", F.col("_metadata.file_name").alias("file_name"))
    fc = raw.select(F.from_json("value", _COLLECTION).alias("fc"), "file_name")
    feats = fc.select(F.explode("fc.features").alias("f"), "file_name")
    return feats.select(F.col("f.properties").alias("properties"),
                        *_geometry_columns(F.col("f")), "file_name")


def read_geojson_seq(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSONSeq: one Feature per line (splittable)."""
    prepare(spark)
    raw = spark.read.text(path).where(F.trim("value") != "")
    feats = raw.select(F.from_json("value", _FEATURE).alias("f"))
    return feats.select(F.col("f.properties").alias("properties"), *_geometry_columns(F.col("f")))


def geojson_properties(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Lift named properties out of the map with ``try_cast`` to the given types."""
    cols = [F.expr(f"try_cast(properties['{k}'] as {t})").alias(k) for k, t in spec.items()]
    rest = [c for c in df.columns if c != "properties"]
    return df.select(*cols, *rest)


# -------------------------------------------------------------------- WKT

def wkt_rings(c) -> "F.Column":
    """POLYGON / MULTIPOLYGON WKT text -> ``array<array<struct<x,y>>>``."""
    c = F.col(c) if isinstance(c, str) else c
    body = F.regexp_replace(F.upper(F.trim(c)), r"^(MULTI)?POLYGON\s*", "")
    # each ring is the text between the innermost parentheses
    ring_txt = F.regexp_extract_all(body, F.lit(r"\(([^()]*)\)"), 1)
    return F.transform(ring_txt, lambda r: F.transform(
        F.split(F.trim(r), r"\s*,\s*"),
        lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"),
                           F.split(F.trim(p), r"\s+")[1].try_cast("double").alias("y"))))


def wkt_point(c):
    """POINT WKT text -> (lon, lat) double columns (null when unparsable)."""
    c = F.col(c) if isinstance(c, str) else c
    inner = F.regexp_extract(c, r"(?i)POINT\s*\(\s*([^)]*)\)", 1)
    parts = F.split(F.trim(inner), r"\s+")
    return (parts[0].try_cast("double"),
            parts[1].try_cast("double"))


def read_wkt_csv(spark: SparkSession, path: str, geom_col: str = "geometry") -> DataFrame:
    """CSV with a WKT geometry column -> ``rings`` (polygons) or
    ``lon``/``lat`` (points) next to the other columns."""
    df = _csv(spark, path)
    if geom_col not in df.columns:
        raise ValueError(f"geometry column {geom_col!r} not found")
    g = F.col(geom_col)
    is_point = F.upper(F.trim(g)).startswith("POINT")
    lon, lat = wkt_point(g)
    return df.select(*[c for c in df.columns if c != geom_col],
                     F.when(is_point, lon).alias("lon"),
                     F.when(is_point, lat).alias("lat"),
                     F.when(~is_point, wkt_rings(g)).alias("rings"))


# ---------------------------------------------------------- dispatch

def _file_system(spark: SparkSession, path: str):
    """Spark's file system for a path of any scheme, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Files of a folder (Parquet and CSV folders count as one), sorted; hidden
    ones left out.  A folder that doesn't exist raises."""
    fs, p = _file_system(spark, folder)
    if not fs.exists(p):
        raise FileNotFoundError(folder)
    found = [s.getPath() for s in fs.listStatus(p) if s.isFile() or os.path.splitext(s.getPath().getName())[1]]
    return sorted(f.toString() for f in found if not f.getName().startswith((".", "_")))


def read_any(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Choose the reader by extension; no path gives ``None``, a path that
    doesn't exist or can't be read raises."""
    if path is None:
        return None
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".json", ".geojson"):
        df = read_geojson(spark, path)
    elif ext == ".parquet":
        prepare(spark)
        df = spark.read.parquet(path)
    elif ext == ".graphml":
        df = read_graphml(spark, path)[1]
    else:
        df = _csv(spark, path)
    df.schema  # resolve now so that unreadable files fail here
    return df


def classify_columns(columns, default: str = "FIR") -> str:
    """``FIR`` if any incident marker column is present, else ``CDR``
    if any call marker is present, else ``default``."""
    cols = {c.lower() for c in columns}
    if any(m in cols for m in INCIDENT_MARKERS):
        return "FIR"
    if any(m in cols for m in CALL_MARKERS):
        return "CDR"
    return default


def read_folder(spark: SparkSession, folder: str,
                refused: list[tuple[str, str]] | None = None) -> dict[str, list[tuple[str, DataFrame]]]:
    """Every file in a folder, classified by its columns and labelled with
    the file stem.  Returns ``{"FIR": [(label, df)], "CDR": [...]}``; the
    normalisers add the ``source`` column and the kinds are unioned by name.  A
    file that can't be read raises, unless a list is given, which then gets
    (path, reason) of each such file."""
    out: dict[str, list] = {"FIR": [], "CDR": []}
    for path in list_files(spark, folder):
        try:
            df = read_any(spark, path)
        except Exception as e:
            if refused is None:
                raise
            refused.append((path, str(e).splitlines()[0]))
            continue
        if "properties" in df.columns:  # GeoJSON: lift the (few) property keys into columns
            keys = sorted(r[0] for r in df.select(F.explode(F.map_keys("properties"))).distinct().collect())
            df = df.select(*[F.col("properties")[k].alias(k) for k in keys],
                           *[c for c in df.columns if c not in ("properties", *keys)])
        kind = classify_columns(df.columns)
        out[kind].append((Path(path).stem, df))
    return out


# ------------------------------------------------------------ graph inputs

def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """GraphML -> ``nodes(id, attributes)`` and ``edges(src, dst,
    attributes)`` via the XML source; attributes: the ``data`` keys and values."""
    prepare(spark)
    data = "data array<struct<_VALUE:string,_key:string>>"

    def rows(tag, fields):
        return spark.read.format("xml").option("rowTag", tag).schema(f"{fields}, {data}").load(path)
    attributes = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(data.split(" ", 1)[1])),
                                                lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("attributes")
    nodes = rows("node", "_id string").select(F.col("_id").alias("id"), attributes)
    edges = rows("edge", "_source string, _target string").select(
        F.col("_source").alias("src"), F.col("_target").alias("dst"), attributes)
    return nodes, edges


def read_edge_list(spark: SparkSession, path: str, u: str = "u", v: str = "v") -> DataFrame:
    """CSV edge list with ``u``/``v`` columns -> ``edges(src, dst)``."""
    df = _csv(spark, path)
    return df.select(F.col(u).alias("src"), F.col(v).alias("dst"))


def read_exported_graph(spark: SparkSession, nodes_path: str, edges_path: str,
                        fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """nodes/edges exported from a graph store.  The first label is kept
    (default ``Entity``); relationships become undirected canonical pairs."""
    prepare(spark)
    rd = spark.read.format(fmt)
    if fmt == "csv":
        rd = rd.option("header", True)
    n = rd.load(nodes_path)
    e = rd.load(edges_path)
    label = (F.coalesce(F.try_element_at(F.col("labels"), F.lit(1)), F.lit("Entity"))
             if "labels" in n.columns and isinstance(n.schema["labels"].dataType, T.ArrayType)
             else F.coalesce(F.col("label"), F.lit("Entity")) if "label" in n.columns
             else F.lit("Entity"))
    nodes = n.select(F.col("id").cast("string").alias("id"), label.alias("label"))
    s, d = F.col(e.columns[0]).cast("string"), F.col(e.columns[1]).cast("string")
    rel = F.col("rel") if "rel" in e.columns else F.col("type") if "type" in e.columns else F.lit(None)
    edges = (e.select(F.least(s, d).alias("src"), F.greatest(s, d).alias("dst"),
                      rel.cast("string").alias("relation"))
             .groupBy("src", "dst").agg(F.max("relation").alias("relation")))
    return nodes, edges
