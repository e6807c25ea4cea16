"""Writers: CSV, GeoJSONSeq, GraphML, keyed upsert tables and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GEOMETRY_COLS = ("geometry", "geom", "rings", "point")


def _flatten_for_csv(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, include_geometry: bool = False,
              mode: str = "overwrite") -> str:
    """CSV with header; geometry columns dropped unless asked for;
    nested values written as JSON text (CSV has no arrays)."""
    if not include_geometry:
        df = df.drop(*[c for c in df.columns if c in GEOMETRY_COLS])
    _flatten_for_csv(df).write.mode(mode).option("header", True).csv(path)
    return path


def geojson_features(df: DataFrame, lon: str = "longitude", lat: str = "latitude",
                     rings: str | None = None) -> DataFrame:
    """One GeoJSON Feature (as JSON text) per row; other columns become
    properties.  Rows with a null geometry get ``"geometry": null``."""
    skip = {lon, lat} | ({rings} if rings else set())
    props = [F.col(c) for c in df.columns if c not in skip and c not in GEOMETRY_COLS]
    if rings:
        coords = F.transform(F.col(rings), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
        geom = F.when(F.col(rings).isNotNull(),
                      F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))
    else:
        geom = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(),
                      F.struct(F.lit("Point").alias("type"),
                               F.array(F.col(lon), F.col(lat)).alias("coordinates")))
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(*props).alias("properties"), geom.alias("geometry"))
    return df.select(F.to_json(feat, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson_seq(df: DataFrame, path: str, lon: str = "longitude", lat: str = "latitude",
                      rings: str | None = None, mode: str = "overwrite") -> str:
    """GeoJSONSeq (one Feature per line), written in parallel."""
    geojson_features(df, lon, lat, rings).write.mode(mode).text(path)
    return path


def _xml_escape(c):
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(nodes: DataFrame, edges: DataFrame, node_attrs=("label",),
                  edge_attrs=("relation",)) -> DataFrame:
    """GraphML document as ordered lines.  ``union`` keeps partition order,
    so header, node lines, edge lines and footer land in part files in
    document order; the part files concatenated form the document."""
    spark = nodes.sparkSession
    keys = ([f'  <key id="{a}" for="node" attr.name="{a}" attr.type="string"/>' for a in node_attrs]
            + [f'  <key id="{a}" for="edge" attr.name="{a}" attr.type="string"/>' for a in edge_attrs])
    head = ['<?xml version="1.0" encoding="UTF-8"?>',
            '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys,
            '  <graph id="G" edgedefault="undirected">']
    foot = ["  </graph>", "</graphml>"]

    def data(attrs):
        parts = []
        for a in attrs:
            parts += [F.lit(f'<data key="{a}">'), F.coalesce(_xml_escape(a), F.lit("")), F.lit("</data>")]
        return parts

    n_attrs = [a for a in node_attrs if a in nodes.columns]
    e_attrs = [a for a in edge_attrs if a in edges.columns]
    nl = nodes.select(F.concat(F.lit('    <node id="'), _xml_escape("id"), F.lit('">'),
                               *data(n_attrs), F.lit("</node>")).alias("value"))
    el = edges.select(F.concat(F.lit('    <edge source="'), _xml_escape("src"),
                               F.lit('" target="'), _xml_escape("dst"), F.lit('">'),
                               *data(e_attrs), F.lit("</edge>")).alias("value"))
    h = spark.createDataFrame([(x,) for x in head], "value string").coalesce(1)
    f = spark.createDataFrame([(x,) for x in foot], "value string").coalesce(1)
    return h.union(nl).union(el).union(f)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite",
                  node_attrs=("label",), edge_attrs=("relation",)) -> str:
    """GraphML as ordered text part files (concatenate in name order)."""
    graphml_lines(nodes, edges, node_attrs, edge_attrs).write.mode(mode).text(path)
    return path


def upsert(existing: DataFrame | None, new: DataFrame, key: list[str] | str,
           order: str | None = None) -> DataFrame:
    """W4 (merge): union old and new rows and keep one row per key, the new
    one winning (or the greatest ``order``).  ``max_by`` is a partial
    aggregate, so a hot key is reduced map-side before the shuffle."""
    key = [key] if isinstance(key, str) else list(key)
    new = new.withColumn("_v_gen", F.lit(1))
    if existing is not None:
        new = existing.withColumn("_v_gen", F.lit(0)).unionByName(new, allowMissingColumns=True)
    payload = [c for c in new.columns if c not in key and c != "_v_gen"]
    rank = F.struct(F.col(order), F.col("_v_gen")) if order else F.col("_v_gen")
    out = new.groupBy(*key).agg(F.max_by(F.struct(*payload), rank).alias("_row"))
    return out.select(*key, "_row.*")


def append(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """W4 (create): append-only union, e.g. for call edges."""
    return new if existing is None else existing.unionByName(new, allowMissingColumns=True)


def assert_unique(df: DataFrame, key: list[str] | str) -> DataFrame:
    """Keys that occur more than once (must be empty)."""
    key = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*key).count().where(F.col("count") > 1)
