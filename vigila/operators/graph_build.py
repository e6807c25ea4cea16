"""Property-graph construction (B1-B10, G5) as node and edge tables.

``nodes(id, label, key, source, props map<string,string>)`` and
``edges(src, dst, relation, start_time, duration, distance_m, ord)``.
Identifiers of people and phones are salted hashes; raw values are not
stored next to them.  The multigraph (every call) is kept as produced;
:func:`simple_graph` collapses it to one undirected edge per node pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.privacy import hash_id
from ..functions.text import is_array, split_list, clip
from .spatial import near_pairs

GRAPH_HASH_LEN = 20

NODE_SCHEMA = "id string, label string, key string, source string, props map<string,string>"
EDGE_COLS = ["src", "dst", "relation", "start_time", "duration", "distance_m", "ord"]

# Display colours by node label and default colour.
LABEL_COLOURS = {"Person": "#ffcc00", "Phone": "#ff6666", "Case": "#66cc66"}
DEFAULT_COLOUR = "#97c2fc"


def _nid(label: str, key, source=None, scoped: bool = False):
    parts = [F.lit(label + "::")]
    if scoped and source is not None:
        parts += [source, F.lit("::")]
    return F.concat(*parts, key)


def _edges(df: DataFrame, src, dst, relation: str, start_time=None, duration=None,
           distance=None, ord_=None) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"),
                     (start_time if start_time is not None else F.lit(None)).cast("timestamp_ntz").alias("start_time"),
                     (duration if duration is not None else F.lit(None)).cast("double").alias("duration"),
                     (distance if distance is not None else F.lit(None)).cast("double").alias("distance_m"),
                     (ord_ if ord_ is not None else F.lit(None)).cast("string").alias("ord"))


def _nodes(df: DataFrame, nid, label: str, key, source=None, props=None) -> DataFrame:
    return df.select(nid.alias("id"), F.lit(label).alias("label"), key.cast("string").alias("key"),
                     (source if source is not None else F.lit(None)).cast("string").alias("source"),
                     (props if props is not None else F.create_map().cast("map<string,string>")).alias("props"))


def no_edges(spark) -> DataFrame:
    return spark.createDataFrame([], "src string, dst string, relation string, start_time timestamp_ntz, "
                                     "duration double, distance_m double, ord string")


def with_loc_id(locations: DataFrame) -> DataFrame:
    """``loc_id``, or an id from the row's content."""
    if "loc_id" in locations.columns:
        return locations
    from .normalize import content_id
    return locations.withColumn("loc_id", F.concat(F.lit("loc_"), content_id(locations)))


def _src_col(df: DataFrame):
    return F.col("source") if "source" in df.columns else F.lit(None).cast("string")


def case_graph(incidents: DataFrame, salt: str, with_victims: bool = True,
               scoped: bool = False) -> tuple[DataFrame, DataFrame]:
    """B1 + B2: Case nodes, Person nodes (hashed), CO_OFFEND edges
    Person->Case and INVOLVED_IN edges victim->Case."""
    inc = incidents.where(F.col("fir_id").isNotNull())
    src = _src_col(inc)
    case_id = _nid("Case", F.col("fir_id").cast("string"), src, scoped)
    props = F.create_map(F.lit("crime_type"), F.col("crime_type").cast("string"),
                         F.lit("date_time"), F.date_format("date_time", "yyyy-MM-dd HH:mm:ss"))
    cases = _nodes(inc, case_id, "Case", F.col("fir_id"), src, props)
    node_parts, edge_parts = [cases], []
    roles = [("accused_list", "CO_OFFEND")] + ([("victim_list", "INVOLVED_IN")] if with_victims else [])
    for col, rel in roles:
        if col not in inc.columns:
            continue
        m = inc.select(case_id.alias("_case"), src.alias("_s"), "date_time", F.col("fir_id"),
                       F.explode(split_list(col, is_array=is_array(inc, col))).alias("_p"))
        pkey = hash_id(F.col("_p"), salt, GRAPH_HASH_LEN)
        pid = _nid("Person", pkey, F.col("_s"), scoped)
        node_parts.append(_nodes(m, pid, "Person", pkey, F.col("_s")))
        edge_parts.append(_edges(m, pid, F.col("_case"), rel, start_time=F.col("date_time"),
                                 ord_=F.col("fir_id")))
    edges = _union(edge_parts) if edge_parts else no_edges(inc.sparkSession)
    return _union(node_parts), edges


def phone_graph(calls: DataFrame, salt: str, scoped: bool = False) -> tuple[DataFrame, DataFrame]:
    """B3 + B4: Phone nodes (hashed), CALLED edges caller->receiver with
    start time and duration (null -> 0), Device nodes and USED_BY_PHONE
    edges from a non-empty ``imei``.  Calls missing an end are skipped."""
    c = calls.where(F.col("caller_id").isNotNull() & F.col("receiver_id").isNotNull())
    src = _src_col(c)
    a_key, b_key = hash_id("caller_id", salt, GRAPH_HASH_LEN), hash_id("receiver_id", salt, GRAPH_HASH_LEN)
    a_id, b_id = _nid("Phone", a_key, src, scoped), _nid("Phone", b_key, src, scoped)
    nodes = [_nodes(c, a_id, "Phone", a_key, src), _nodes(c, b_id, "Phone", b_key, src)]
    edges = [_edges(c, a_id, b_id, "CALLED", F.col("start_time"),
                    F.coalesce(F.col("duration_seconds"), F.lit(0.0)),
                    ord_=F.col("cdr_id"))]
    if "imei" in c.columns:
        d = c.where(F.col("imei").isNotNull() & (F.trim(F.col("imei").cast("string")) != ""))
        dev = _nid("Device", F.col("imei").cast("string"))
        nodes.append(_nodes(d, dev, "Device", F.col("imei")))
        edges.append(_edges(d, dev, _nid("Phone", hash_id("caller_id", salt, GRAPH_HASH_LEN), _src_col(d), scoped),
                            "USED_BY_PHONE", ord_=F.col("cdr_id")))
    return _union(nodes), _union(edges)


def device_graph(devices: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """Device map -> Device nodes, Phone nodes, ASSOCIATED_WITH edges
    (the same salt as the call graph, so phones line up)."""
    d = devices.where(F.col("imei").isNotNull())
    dev = _nid("Device", F.col("imei").cast("string"))
    nodes = [_nodes(d, dev, "Device", F.col("imei"))]
    p = d.where(F.col("phone_number").isNotNull())
    pkey = hash_id("phone_number", salt, GRAPH_HASH_LEN)
    nodes.append(_nodes(p, _nid("Phone", pkey), "Phone", pkey))
    edges = _edges(p, _nid("Device", F.col("imei").cast("string")), _nid("Phone", pkey), "ASSOCIATED_WITH",
                   ord_=F.col("imei").cast("string"))
    return _union(nodes), edges


def location_nodes(locations: DataFrame) -> DataFrame:
    """Location nodes (``loc_id`` or a content id)."""
    loc = with_loc_id(locations)
    props = F.create_map(F.lit("name"), clip(F.coalesce(F.col("name"), F.lit("")), 120) if "name" in loc.columns
                         else F.lit(""),
                         F.lit("latitude"), F.col("latitude").cast("string"),
                         F.lit("longitude"), F.col("longitude").cast("string"))
    return _nodes(loc, _nid("Location", F.col("loc_id").cast("string")), "Location", F.col("loc_id"), props=props)


def near_location_edges(incidents: DataFrame, locations: DataFrame, radius_m: float = 100.0) -> DataFrame:
    """Case->Location NEAR_LOCATION edges within ``radius_m``
    (haversine), carrying the distance."""
    inc = incidents.select(F.concat(F.lit("Case::"), F.col("fir_id").cast("string")).alias("id"),
                           F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    loc = with_loc_id(locations).select(F.concat(F.lit("Location::"), F.col("loc_id").cast("string")).alias("id"),
                           F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"))
    p = near_pairs(inc, loc, radius_m, "haversine")
    return _edges(p, F.col("left_id"), F.col("right_id"), "NEAR_LOCATION", distance=F.col("distance_m"))


def tower_graph(incidents: DataFrame, calls: DataFrame, proximity_m: float = 100.0,
                metric: str = "degree", scoped: bool = True) -> tuple[DataFrame, DataFrame]:
    """Tower nodes (keyed by ``cell_tower_id`` when present, else
    by coordinates) and Case->Tower NEAR_TOWER edges within the radius."""
    isrc, csrc = _src_col(incidents), _src_col(calls)
    inc = incidents.select(_nid("Case", F.col("fir_id").cast("string"), isrc, scoped).alias("id"),
                           F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    tkey = (F.col("cell_tower_id").cast("string") if "cell_tower_id" in calls.columns
            else F.concat_ws(",", F.col("tower_lat").cast("string"), F.col("tower_lon").cast("string")))
    tw = calls.where(F.col("tower_lat").isNotNull() & F.col("tower_lon").isNotNull()).select(
        _nid("Tower", tkey, csrc, scoped).alias("id"), tkey.alias("key"), csrc.alias("source"),
        F.col("tower_lat").alias("lat"), F.col("tower_lon").alias("lon")).distinct()
    p = near_pairs(inc, tw.select("id", "lat", "lon"), proximity_m, metric)
    edges = _edges(p, F.col("left_id"), F.col("right_id"), "NEAR_TOWER", distance=F.col("distance_m"))
    nodes = _nodes(tw.join(p.select(F.col("right_id").alias("id")).distinct(), "id", "left_semi"),
                   F.col("id"), "Tower", F.col("key"), F.col("source"))
    return nodes, edges


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node id.  ``min_by`` keeps the attributes of the
    smallest key deterministically and reduces hot ids map-side."""
    return (nodes.groupBy("id").agg(F.min_by(F.struct("label", "key", "source", "props"),
                                             F.concat_ws("|", "key", "source")).alias("_n"))
            .select("id", "_n.*"))


def simple_graph(edges: DataFrame) -> DataFrame:
    """One undirected edge per node pair; the last write wins (greatest
    (start_time, ord)), as adding a parallel edge updates the attributes."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    rank = F.struct(F.coalesce(F.col("start_time"), F.lit(None).cast("timestamp_ntz")), F.col("ord"))
    return (edges.withColumns({"_a": a, "_b": b})
            .groupBy("_a", "_b")
            .agg(F.max_by(F.struct("relation", "start_time", "duration", "distance_m", "ord"), rank).alias("_e"))
            .select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "_e.*"))


def build_graph(incidents: DataFrame | None = None, calls: DataFrame | None = None,
                devices: DataFrame | None = None, locations: DataFrame | None = None, *,
                salt: str, proximity_m: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and multigraph edges from whatever inputs are given;
    optional NEAR_LOCATION edges.  Use :func:`simple_graph` on the edges
    for the undirected simple graph the analytics run on."""
    nparts, eparts = [], []
    if incidents is not None:
        n, e = case_graph(incidents, salt)
        nparts.append(n); eparts.append(e)
    if calls is not None:
        n, e = phone_graph(calls, salt)
        nparts.append(n); eparts.append(e)
    if devices is not None:
        n, e = device_graph(devices, salt)
        nparts.append(n); eparts.append(e)
    if locations is not None:
        nparts.append(location_nodes(locations))
        if proximity_m is not None and incidents is not None:
            eparts.append(near_location_edges(incidents, locations, proximity_m))
    if not nparts:
        raise ValueError("no input given")
    edges = _union(eparts) if eparts else no_edges(nparts[0].sparkSession)
    return dedupe_nodes(_union(nparts)), edges


def cross_source_graph(incident_sets: list[DataFrame], call_sets: list[DataFrame], *, salt: str,
                       proximity_m: float = 100.0, scope_by_source: bool = True,
                       metric: str = "degree") -> tuple[DataFrame, DataFrame]:
    """Multi-source graph.  Inputs carry a ``source`` column; with
    ``scope_by_source`` ids are ``Label::source::key`` so jurisdictions only
    meet through towers, otherwise one person or phone links sources."""
    nparts, eparts = [], []
    from .normalize import ensure_cols
    inc = _union([ensure_cols(i, {"accused_list": "string"})
                  .select("fir_id", "crime_type", "date_time", "latitude", "longitude", "accused_list", "source")
                  for i in incident_sets]) if incident_sets else None
    cal = _union([c.select("cdr_id", "caller_id", "receiver_id", "start_time", "duration_seconds",
                           "tower_lat", "tower_lon", "source") for c in call_sets]) if call_sets else None
    if inc is not None:
        n, e = case_graph(inc, salt, with_victims=False, scoped=scope_by_source)
        nparts.append(n); eparts.append(e)
    if cal is not None:
        n, e = phone_graph(cal, salt, scoped=scope_by_source)
        nparts.append(n); eparts.append(e)
    if inc is not None and cal is not None and proximity_m:
        n, e = tower_graph(inc, cal, proximity_m, metric, scoped=scope_by_source)
        nparts.append(n); eparts.append(e)
    return dedupe_nodes(_union(nparts)), _union(eparts)


def display_columns(nodes: DataFrame, degrees: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node size 5 + 6 ln(1 + degree), colour by label, edge width 2
    for calls else 1."""
    colour = F.lit(DEFAULT_COLOUR)
    for lab, col in LABEL_COLOURS.items():
        colour = F.when(F.col("label") == lab, F.lit(col)).otherwise(colour)
    n = (nodes.join(degrees.select("id", "degree"), "id", "left")
         .withColumn("size", F.lit(5.0) + F.log1p(F.coalesce(F.col("degree"), F.lit(0)).cast("double")) * 6)
         .withColumn("color", colour))
    e = edges.withColumn("width", F.when(F.col("relation") == "CALLED", F.lit(2)).otherwise(F.lit(1)))
    return n, e


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
