"""End-to-end jobs (E1-E6).  Each returns DataFrames (and writes when an
output path is given); nothing is collected except bounded scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.privacy import hash_id, hash_array
from ..operators import normalize as N
from ..operators import spatial as S
from ..operators import filters as FL
from ..operators import features as FE
from ..operators import models as M
from ..operators import graph_build as B
from ..operators import graph_algo as GA
from ..operators import communities as CM
from ..operators import links as L
from ..operators import similar_pairs as SP
from ..operators import aggregates as G
from ..sources import readers as R
from ..sources import sinks as W

PII_COLS = ["caller_id", "receiver_id", "victim_age", "victim_gender", "suspect_age", "suspect_gender"]


def anonymise(df: DataFrame, salt: str, cols=PII_COLS, n: int = 16) -> DataFrame:
    """A3: hash the listed columns when present (strings and integers;
    floating columns pass through); array columns are hashed element-wise.
    Nulls stay null."""
    out = {}
    for f in df.schema.fields:
        if f.name not in cols:
            continue
        t = f.dataType.typeName()
        if t == "array":
            out[f.name] = hash_array(f.name, salt, n)
        elif t in ("string", "long", "integer", "short"):
            out[f.name] = hash_id(f.name, salt, n)
    return df.withColumns(out) if out else df


def preprocess(incidents: DataFrame, calls: DataFrame, demographics: DataFrame | None, *, salt: str,
               window_minutes: float = 60, max_distance: float = 500.0, id_lists: bool = False) -> DataFrame:
    """E1 core: clean -> demographics (point in polygon) -> call mapping ->
    anonymise -> features."""
    inc = N.clean_incidents(N.normalize_incidents(incidents))
    cal = N.clean_calls(N.normalize_calls(calls))
    if demographics is not None:
        inc = S.points_in_polygons(inc, demographics)
    mapped = S.map_calls_to_incidents(cal, inc, window_minutes, max_distance, id_lists=id_lists)
    if id_lists:
        mapped = mapped.withColumnsRenamed({"caller_ids": "caller_id", "receiver_ids": "receiver_id"})
    anon = anonymise(mapped, salt)
    if id_lists:
        anon = anon.withColumnsRenamed({"caller_id": "caller_ids", "receiver_id": "receiver_ids"})
    return FE.incident_features(anon)


def run_preprocess(spark: SparkSession, incidents_path: str, calls_path: str, demographics_path: str | None,
                   output_path: str, *, salt: str) -> str:
    """Read CSV inputs (and GeoJSON demographics), preprocess, write CSV."""
    inc = R.read_incidents_csv(spark, incidents_path)
    cal = R.read_calls_csv(spark, calls_path)
    dem = None
    if demographics_path:
        raw = R.read_geojson(spark, demographics_path)
        dem = R.geojson_properties(raw, {"region": "string", "population": "long", "density": "long"}) \
            .where(F.col("rings").isNotNull()).drop("geom_type", "lon", "lat", "file_name")
    out = preprocess(inc, cal, dem, salt=salt).drop("point")
    return W.write_csv(out, output_path)


def run_forecast(spark: SparkSession, incidents: DataFrame, output_path: str | None = None,
                 cell_size: float = 500.0, **kw) -> dict:
    """Hotspot forecast; optionally written as GeoJSONSeq cell boxes."""
    res = M.hotspot_forecast(incidents, cell_size, **kw)
    if output_path:
        g = res["grid"]
        box = F.array(F.array(*[F.struct(S.merc_lon(x).alias("x"), S.merc_lat(y).alias("y")) for x, y in
                                [(F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y0")), (F.col("x1"), F.col("y1")),
                                 (F.col("x0"), F.col("y1")), (F.col("x0"), F.col("y0"))]]))
        W.write_geojson_seq(g.withColumn("rings", box).drop("x0", "y0", "x1", "y1", "cx", "cy"),
                            output_path, rings="rings")
    return res


def build_graph_job(spark: SparkSession, incidents_path=None, calls_path=None, devices_path=None,
                    locations_path=None, *, salt: str, proximity_m: float | None = None,
                    out_graphml: str | None = None, out_tables: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Read whatever inputs exist, normalise, build nodes and edges,
    optionally write GraphML and Parquet node/edge tables."""
    inc = R.read_any(spark, incidents_path)
    cal = R.read_any(spark, calls_path)
    dev = R.read_any(spark, devices_path)
    loc = R.read_any(spark, locations_path)
    if inc is not None:
        inc = N.normalize_incidents(inc)
    if cal is not None:
        cal = N.normalize_calls(cal)
    if loc is not None:
        loc = loc.withColumns({"latitude": N.parse_number("latitude"), "longitude": N.parse_number("longitude")})
    nodes, edges = B.build_graph(inc, cal, dev, loc, salt=salt, proximity_m=proximity_m)
    simple = B.simple_graph(edges)
    if out_graphml:
        W.write_graphml(nodes, simple, out_graphml)
    if out_tables:
        nodes.write.mode("overwrite").parquet(f"{out_tables}/nodes")
        edges.write.mode("overwrite").parquet(f"{out_tables}/edges")
    return nodes, simple


def analyze_graph(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, k: int = 20,
                  sources: DataFrame | None = None,
                  sample_pos: int = 5000, sample_neg: int = 5000, seed: int = 42,
                  supervised: bool = True, epsilon: float = 0.05) -> dict:
    """Centralities, top influencers and bridges, communities by modularity,
    heuristic link scores, supervised link model and its top predictions.  The
    candidate ``pairs`` (u, v) are a relation of the caller's and are all scored.
    Betweenness is sampled to within ``epsilon``, or taken over ``sources`` (all nodes or
    a fair sample of them)."""
    cent = GA.centrality_table(nodes, edges, sources, epsilon=epsilon)
    out = {"centrality": cent,
           "influencers": G.top_k(cent, "pagerank", k, "id"),
           "bridges": G.top_k(cent, "betweenness", k, "id"),
           "communities": CM.louvain(nodes, edges),
           "heuristics": L.heuristic_link_scores(edges, pairs)
           .orderBy(F.col("score_ensemble").desc(), "u", "v")}
    out["modularity"] = GA.modularity(edges, out["communities"])
    if supervised:
        info = L.supervised_link_model(nodes, edges, sample_pos, sample_neg, 0.2, seed)
        out["link_model"] = info
        out["predicted_links"] = L.predict_top_links(edges, pairs, info, 100)
    out["annotated"] = GA.annotate(GA.annotate(nodes, cent), out["communities"].select("id", "community"))
    return out


def cross_source(spark: SparkSession, folder: str, *, salt: str, categories=None, date_range=None,
                 bbox=None, min_degree: int = 0, proximity_m: float = 200.0, scope_by_source: bool = True,
                 top: int = 15) -> dict:
    """E5: read a folder of per-jurisdiction files, classify and normalise
    them with their source label, filter, build the multi-source graph,
    degree and PageRank, the minimum-degree subgraph and its top nodes."""
    files = R.read_folder(spark, folder)
    incs = [N.normalize_incidents(df, label) for label, df in files["FIR"]]
    cals = [N.normalize_calls(df, label) for label, df in files["CDR"]]
    incs = [FL.filter_incidents(d, categories, date_range, bbox) for d in incs]
    cals = [FL.filter_calls(d, date_range, bbox) for d in cals]
    nodes, medges = B.cross_source_graph(incs, cals, salt=salt, proximity_m=proximity_m,
                                         scope_by_source=scope_by_source)
    edges = B.simple_graph(medges)
    deg = GA.degree(nodes, edges)
    pr = GA.pagerank(nodes, edges)
    sub_n, sub_e = FL.min_degree_subgraph(nodes, edges, deg, min_degree)
    table = sub_n.select("id", "label").join(pr, "id").join(deg, "id")
    points = None
    if incs or cals:
        parts = [d.select(F.col("fir_id").alias("id"), "date_time", "source", "latitude", "longitude",
                          F.lit("FIR").alias("type")) for d in incs]
        parts += [d.select(F.col("cdr_id").alias("id"), F.col("start_time").alias("date_time"), "source",
                           F.col("tower_lat").alias("latitude"), F.col("tower_lon").alias("longitude"),
                           F.lit("CDR").alias("type")) for d in cals]
        points = parts[0]
        for p in parts[1:]:
            points = points.unionByName(p, allowMissingColumns=True)
    return {"nodes": nodes, "edges": edges, "degree": deg, "pagerank": pr, "subgraph_nodes": sub_n,
            "subgraph_edges": sub_e, "top": G.top_k(table, "pagerank", top, "id"),
            "counts": G.graph_counts(nodes, edges), "points": points,
            "center": S.layer_center(points) if points is not None else None}


def candidate_pairs(calls: DataFrame, edges: DataFrame, salt: str, threshold: float = 0.3,
                    min_common: int = 2, nbrs: L.Neighbours | None = None) -> DataFrame:
    """Pairs (u, v) that are not linked: phones with a contact in common within
    an hour, and nodes of any kind whose neighbours overlap by ``threshold`` or more."""
    near = L.shared_contact_pairs(calls, edges, salt, nbrs=nbrs)
    return L.with_pairs(near, SP.similar_pairs(edges, threshold, min_common))


def run_all(spark: SparkSession, incidents: DataFrame, calls: DataFrame, *, salt: str,
            pairs: DataFrame | None = None, epsilon: float = 0.05) -> dict:
    """Hotspots, cleaned incidents and calls, the graph, its
    centralities and predicted links, as one dictionary of DataFrames.  Links are
    predicted among ``pairs`` (u, v), by default :func:`candidate_pairs`."""
    inc = N.clean_incidents(N.normalize_incidents(incidents))
    cal = N.clean_calls(N.normalize_calls(calls))
    nodes, edges = B.build_graph(inc, cal, salt=salt)
    simple = B.simple_graph(edges)
    hot = M.hotspot_forecast(inc)
    if pairs is None:
        pairs = candidate_pairs(cal, simple, salt)
    ana = analyze_graph(nodes, simple, pairs, supervised=True, epsilon=epsilon)
    return {"hotspots": hot["grid"], "fir": inc, "cdr": cal, "graph_nodes": nodes, "graph_edges": simple,
            "centrality": ana["centrality"], "predictions": ana["predicted_links"]}
