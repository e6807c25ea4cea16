"""Spatial operators (P1-P16) and the spatio-temporal call<->incident join.

Theta joins (distance thresholds, time windows, point in polygon) are
rewritten as equi-joins on grid buckets followed by the exact predicate:
one side is assigned to a single bucket, the other is replicated to the
buckets that its reach touches.  A bucket is twice the reach wide, so that is
two buckets an axis.  No nested-loop or cartesian
join is planned, the work is proportional to the candidate pairs, and a
hot bucket is split by AQE's skew-join handling.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import (merc_x, merc_y, merc_lon, merc_lat, haversine_m, planar_m,
                             degree_dist_m, unit_xyz, rings_contain, DEG_M)
from ..functions.timefn import micros, minutes_apart


# --------------------------------------------------------------- P1, P6

def project(df: DataFrame, lon: str = "longitude", lat: str = "latitude",
            x: str = "x", y: str = "y") -> DataFrame:
    """Add EPSG:3857 coordinates (null when either input is null)."""
    ok = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    return df.withColumns({x: F.when(ok, merc_x(lon)), y: F.when(ok, merc_y(lat))})


def unproject(df: DataFrame, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """P1 inverse: EPSG:3857 -> lon/lat."""
    return df.withColumns({lon: merc_lon(x), lat: merc_lat(y)})


def bounds(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One-row bounding box (nulls ignored)."""
    return df.agg(F.min(x).alias("minx"), F.min(y).alias("miny"),
                  F.max(x).alias("maxx"), F.max(y).alias("maxy"))


# --------------------------------------------------------------- P5, P7

def grid_spec(points: DataFrame, cell_size: float = 500.0, x: str = "x", y: str = "y") -> DataFrame:
    """P5 parameters: origin and cell counts of a square grid over the
    points' bounding box.  Cells are half-open ``[lo, lo+size)``; the
    count per axis is ``floor(extent/size)+1`` so that every point,
    including those on the max edge, falls in a cell."""
    b = bounds(points, x, y)
    return b.select("*", F.lit(float(cell_size)).alias("size"),
                    (F.floor((F.col("maxx") - F.col("minx")) / cell_size) + 1).alias("nx"),
                    (F.floor((F.col("maxy") - F.col("miny")) / cell_size) + 1).alias("ny"))


def _spec_scalar(spec: DataFrame):
    """The one-row spec as a scalar subquery struct (computed once, no join)."""
    return spec.select(F.struct("minx", "miny", "size", "nx", "ny").alias("s")).scalar()


def cell_id(ix, iy):
    return F.concat(F.lit("cell_"), ix.cast("string"), F.lit("_"), iy.cast("string"))


def assign_cells(points: DataFrame, spec: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Cell of each point by arithmetic (no spatial join).  Points with
    no coordinates keep a null ``cell_id`` (left-join semantics)."""
    s = _spec_scalar(spec)
    ix = F.floor((F.col(x) - s["minx"]) / s["size"])
    iy = F.floor((F.col(y) - s["miny"]) / s["size"])
    return points.withColumns({"ix": ix, "iy": iy}).withColumn("cell_id", cell_id(F.col("ix"), F.col("iy")))


def grid_cells(spec: DataFrame, partitions: int | None = None) -> DataFrame:
    """P5: every cell of the grid, empty ones included, with its box,
    centroid (EPSG:3857 and lon/lat).  Columns are generated in two
    steps - x indices from the one-row spec, then y indices per x row
    after a round-robin repartition - so no single task builds the grid."""
    n = partitions or int(spec.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    xs = spec.select(F.explode(F.sequence(F.lit(0), F.col("nx").cast("int") - 1)).alias("ix"),
                     "minx", "miny", "size", "ny")
    cells = (xs.repartition(n)
               .select("ix", F.explode(F.sequence(F.lit(0), F.col("ny").cast("int") - 1)).alias("iy"),
                       "minx", "miny", "size"))
    x0 = F.col("minx") + F.col("ix") * F.col("size")
    y0 = F.col("miny") + F.col("iy") * F.col("size")
    out = cells.select(cell_id(F.col("ix"), F.col("iy")).alias("cell_id"),
                       F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"),
                       x0.alias("x0"), y0.alias("y0"),
                       (x0 + F.col("size")).alias("x1"), (y0 + F.col("size")).alias("y1"),
                       (x0 + F.col("size") / 2).alias("cx"), (y0 + F.col("size") / 2).alias("cy"))
    return out.withColumns({"lon": merc_lon("cx"), "lat": merc_lat("cy")})


# ------------------------------------------------------------------- P11

def layer_center(points: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Centroid of the union of a point layer = mean of distinct points."""
    return (points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
            .select(lon, lat).distinct()
            .agg(F.avg(lon).alias("lon"), F.avg(lat).alias("lat")))


# -------------------------------------------------------------------- J1

def _bucket(at, reach) -> F.Column:
    """The bucket that holds ``at``."""
    return F.floor(at / (F.lit(2.0) * reach))


def _buckets_near(at, reach) -> F.Column:
    """The buckets that hold anything within ``reach`` of ``at``: two, as a rule."""
    return F.sequence(_bucket(at - reach, reach), _bucket(at + reach, reach))


def call_incident_matches(calls: DataFrame, incidents: DataFrame, window_minutes: float = 60,
                          max_distance: float = 500.0, metric: str = "mercator") -> DataFrame:
    """Every (incident, call) pair with |dt| <= window and distance <=
    max_distance, both inclusive.

    ``metric='mercator'`` measures planar EPSG:3857 units (as the source
    tool does); ``'haversine'`` measures metres on the ground.  Calls sit in
    one (time, x, y) bucket; incidents are replicated to the buckets in their
    reach (8 as a rule); the equi-join on the bucket triple is followed by the
    exact filter, so each qualifying pair appears exactly once.
    """
    step_us = F.lit(float(window_minutes) * 60e6 + 1)  # a little more than what may match
    c = calls.where(F.col("start_time").isNotNull() & F.col("tower_lat").isNotNull()
                    & F.col("tower_lon").isNotNull())
    i = incidents.where(F.col("date_time").isNotNull() & F.col("latitude").isNotNull()
                        & F.col("longitude").isNotNull())
    if metric == "mercator":
        c = c.withColumns({"_x": merc_x("tower_lon"), "_y": merc_y("tower_lat")})
        i = i.withColumns({"_x": merc_x("longitude"), "_y": merc_y("latitude")})
        size = float(max_distance)
    elif metric == "haversine":
        # Bucket in Mercator with a size that bounds ground distance at the
        # highest |latitude| present (scale factor 1/cos(lat)).
        c = c.withColumns({"_x": merc_x("tower_lon"), "_y": merc_y("tower_lat")})
        i = i.withColumns({"_x": merc_x("longitude"), "_y": merc_y("latitude")})
        maxlat = (i.select(F.abs("latitude").alias("a"))
                  .unionByName(c.select(F.abs("tower_lat").alias("a")))
                  .agg(F.max("a")).scalar())
        size = F.lit(float(max_distance)) / F.cos(F.radians(F.least(maxlat, F.lit(89.9))))
    else:
        raise ValueError("metric must be 'mercator' or 'haversine'")
    size_c = (size if not isinstance(size, float) else F.lit(size)) * (1 + 1e-9) + 1e-6

    c = c.select("cdr_id", "caller_id", "receiver_id", "start_time", "duration_seconds",
                 "tower_lat", "tower_lon", "_x", "_y", _bucket(micros("start_time"), step_us).alias("bt"),
                 _bucket(F.col("_x"), size_c).alias("bx"), _bucket(F.col("_y"), size_c).alias("by"))
    i = (i.select("fir_id", "date_time", "latitude", "longitude",
                  F.col("_x").alias("_ix"), F.col("_y").alias("_iy"))
          .withColumn("bt", F.explode(_buckets_near(micros("date_time"), step_us)))
          .withColumn("bx", F.explode(_buckets_near(F.col("_ix"), size_c)))
          .withColumn("by", F.explode(_buckets_near(F.col("_iy"), size_c))))
    j = c.join(i, ["bt", "bx", "by"], "inner")
    tdiff = minutes_apart("start_time", "date_time")
    if metric == "mercator":
        dist = planar_m("_x", "_y", "_ix", "_iy")
    else:
        dist = haversine_m("tower_lat", "tower_lon", "latitude", "longitude")
    j = j.withColumns({"time_diff_minutes": tdiff, "distance_m": dist})
    j = j.where((F.col("time_diff_minutes") <= window_minutes) & (F.col("distance_m") <= max_distance))
    return j.select("fir_id", "cdr_id", "caller_id", "receiver_id", "start_time",
                    "duration_seconds", "time_diff_minutes", "distance_m")


def incident_call_summary(matches: DataFrame, id_lists: bool = False) -> DataFrame:
    """G1: per incident, count/min/max start time and mean duration, time
    difference and distance.  All are partial aggregates.  ``id_lists``
    also collects the call, caller and receiver ids (sorted); that list is
    as long as the incident's matches, so it is off by default - the
    match table itself is the long form of the same information."""
    aggs = [F.min("start_time").alias("start_time_min"), F.max("start_time").alias("start_time_max"),
            F.count("cdr_id").alias("start_time_count"),
            F.avg("duration_seconds").alias("duration_seconds_mean"),
            F.avg("time_diff_minutes").alias("time_diff_minutes_mean"),
            F.avg("distance_m").alias("distance_m_mean")]
    if id_lists:
        aggs += [F.sort_array(F.collect_list("cdr_id")).alias("cdr_ids"),
                 F.sort_array(F.collect_list("caller_id")).alias("caller_ids"),
                 F.sort_array(F.collect_list("receiver_id")).alias("receiver_ids")]
    return matches.groupBy("fir_id").agg(*aggs)


def map_calls_to_incidents(calls: DataFrame, incidents: DataFrame, window_minutes: float = 60,
                           max_distance: float = 500.0, metric: str = "mercator",
                           id_lists: bool = False) -> DataFrame:
    """J1 + G1 + J2: incidents left-joined with their call summary."""
    m = call_incident_matches(calls, incidents, window_minutes, max_distance, metric)
    return incidents.join(incident_call_summary(m, id_lists), "fir_id", "left")


# --------------------------------------------------------- P12, P13, P4

def near_pairs(left: DataFrame, right: DataFrame, radius_m: float = 100.0,
               metric: str = "haversine",
               l_cols=("id", "lat", "lon"), r_cols=("id", "lat", "lon")) -> DataFrame:
    """All (left, right) pairs within ``radius_m`` (inclusive),
    with the distance.  ``haversine`` buckets unit-sphere chords (exact
    bound: chord <= 2 sin(r / 2R)); ``degree`` is the coarse planar
    degrees x 111 km metric; ``mercator`` is planar EPSG:3857.
    Output: ``left_id, right_id, distance_m``."""
    lid, llat, llon = l_cols
    rid, rlat, rlon = r_cols
    L = left.where(F.col(llat).isNotNull() & F.col(llon).isNotNull()) \
        .select(F.col(lid).alias("left_id"), F.col(llat).alias("_la"), F.col(llon).alias("_lo"))
    R = right.where(F.col(rlat).isNotNull() & F.col(rlon).isNotNull()) \
        .select(F.col(rid).alias("right_id"), F.col(rlat).alias("_rla"), F.col(rlon).alias("_rlo"))
    # a little more than what may match, against rounding
    if metric == "haversine":
        from ..functions.geo import HAV_R
        size = 2.0 * math.sin(radius_m / (2.0 * HAV_R)) * (1 + 1e-9) + 1e-14
        lx, ly, lz = unit_xyz("_la", "_lo")
        rx, ry, rz = unit_xyz("_rla", "_rlo")
        keysL, keysR = [lx, ly, lz], [rx, ry, rz]
        dist = haversine_m("_la", "_lo", "_rla", "_rlo")
    elif metric == "degree":
        size = radius_m / DEG_M * (1 + 1e-9) + 1e-12
        keysL, keysR = [F.col("_lo"), F.col("_la")], [F.col("_rlo"), F.col("_rla")]
        dist = degree_dist_m("_la", "_lo", "_rla", "_rlo")
    elif metric == "mercator":
        size = float(radius_m) * (1 + 1e-9) + 1e-6
        keysL, keysR = [merc_x("_lo"), merc_y("_la")], [merc_x("_rlo"), merc_y("_rla")]
        dist = planar_m(merc_x("_lo"), merc_y("_la"), merc_x("_rlo"), merc_y("_rla"))
    else:
        raise ValueError("metric must be 'haversine', 'degree' or 'mercator'")
    names = [f"_b{i}" for i in range(len(keysL))]
    L = L.withColumns({n: _bucket(k, F.lit(size)) for n, k in zip(names, keysL)})
    for n, k in zip(names, keysR):  # replicate the right side to the buckets in reach, 2^d as a rule
        R = R.withColumn(n, F.explode(_buckets_near(k, F.lit(size))))
    j = L.join(R, names, "inner")
    if metric == "haversine":  # cheap, and leaves half of the candidates
        j = j.where(F.abs(F.col("_la") - F.col("_rla")) <= math.degrees(radius_m / HAV_R) * (1 + 1e-9) + 1e-9)
    j = j.withColumn("distance_m", dist)
    return j.where(F.col("distance_m") <= radius_m).select("left_id", "right_id", "distance_m")


# -------------------------------------------------------------------- P8

def points_in_polygons(points: DataFrame, polygons: DataFrame, lon: str = "longitude",
                       lat: str = "latitude", rings: str = "rings", bucket_deg: float = 0.05,
                       per_polygon: int = 64) -> DataFrame:
    """Left spatial join, predicate *within*: one row per (point,
    containing polygon), points in no polygon kept once with null polygon
    columns.  Polygon ids are copied to the grid buckets of their bounding box,
    about ``per_polygon`` of them (a large box gets larger buckets), and points
    meet them by level and bucket; the rings are fetched by id afterwards for
    the ray cast.  Points without coordinates keep out of the join."""
    from ..session import cut_lineage
    pcols = [c for c in polygons.columns if c != rings]
    flat = F.flatten(F.col(rings))
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    poly = cut_lineage(polygons.withColumn("_pid", F.monotonically_increasing_id()))
    box = poly.select("_pid", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"),
                      F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    # level: buckets of bucket_deg * 2^level, so that a box covers few of them
    cells = (F.col("x1") - F.col("x0") + bucket_deg) * (F.col("y1") - F.col("y0") + bucket_deg) / (bucket_deg ** 2)
    box = box.withColumn("_level", F.greatest(F.ceil(F.log2(cells / per_polygon) / 2), F.lit(0)).cast("int"))
    width = F.lit(bucket_deg) * F.pow(F.lit(2.0), F.col("_level"))
    box = (box.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("x0") / width), F.floor(F.col("x1") / width))))
              .withColumn("_by", F.explode(F.sequence(F.floor(F.col("y0") / width), F.floor(F.col("y1") / width)))))
    levels = [r[0] for r in box.select("_level").distinct().collect()]  # at most about a dozen
    pts = cut_lineage(points.withColumn("_qid", F.monotonically_increasing_id()))
    at = pts.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(
        "_qid", F.col(lon).alias("_x"), F.col(lat).alias("_y"),
        F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")).alias("_level"))
    at = at.withColumns({"_bx": F.floor(F.col("_x") / width), "_by": F.floor(F.col("_y") / width)})
    near = at.join(box.select("_pid", "_level", "_bx", "_by", "x0", "x1", "y0", "y1"), ["_level", "_bx", "_by"])
    near = near.where(F.col("_x").between(F.col("x0"), F.col("x1")) & F.col("_y").between(F.col("y0"), F.col("y1")))
    hit = near.join(poly.select("_pid", F.col(rings).alias("_rings"), F.struct(*pcols).alias("_p")), "_pid")
    hit = hit.where(rings_contain(F.col("_rings"), F.col("_x"), F.col("_y"))).select("_qid", "_p")
    return pts.join(hit, "_qid", "left").select(*points.columns, *[F.col("_p")[c].alias(c) for c in pcols])


def polygon_at(polygons: DataFrame, lon: float, lat: float, order: str, rings: str = "rings") -> DataFrame:
    """The first polygon (by ``order``) containing one given point."""
    flat = F.flatten(F.col(rings))
    box = ((F.array_min(F.transform(flat, lambda p: p["x"])) <= lon)
           & (F.array_max(F.transform(flat, lambda p: p["x"])) >= lon)
           & (F.array_min(F.transform(flat, lambda p: p["y"])) <= lat)
           & (F.array_max(F.transform(flat, lambda p: p["y"])) >= lat))
    return (polygons.where(box).where(rings_contain(F.col(rings), F.lit(lon), F.lit(lat)))
            .orderBy(order).limit(1))


def bbox_filter(df: DataFrame, bbox, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """P10: strict-interior bounding-box filter; null geometry dropped.
    ``bbox`` is ``(minlon, minlat, maxlon, maxlat)`` or the text
    ``"a,b,c,d"`` (bad text raises)."""
    if isinstance(bbox, str):
        a, b, c, d = [float(v.strip()) for v in bbox.split(",")]
    else:
        a, b, c, d = [float(v) for v in bbox]
    return df.where((F.col(lon) > a) & (F.col(lon) < c) & (F.col(lat) > b) & (F.col(lat) < d))


# ------------------------------------------------------------------- P16

# exp(-t) underflows to exactly 0.0 in double precision for t > 745.2, so a
# Gaussian term is exactly zero beyond 38.61 bandwidths: cutting the join
# there gives the same double result as summing over every point.
KDE_EXACT_CUTOFF = 38.7
# Parts of a bucket; partial sums per cell meet in the final aggregate.
KDE_SALTS = 16


def kde_cells(points: DataFrame, cells: DataFrame, bandwidth: float = 1000.0,
              last_hours: float | None = 72.0, time_col: str = "date_time",
              lon: str = "longitude", lat: str = "latitude",
              reach: float = KDE_EXACT_CUTOFF) -> DataFrame:
    """Gaussian kernel density at cell centroids (``cx``, ``cy`` in
    EPSG:3857) from the points of the last ``last_hours`` before the
    data's latest time, min-max scaled with a 1e-9 guard; 0 when there
    are no recent points.

    density(c) = sum_i exp(-|c - p_i|^2 / 2h^2) / (n * 2 pi h^2).
    Identical points are pre-aggregated with a weight; the points x cells
    pairing is a bucket join whose reach (38.7 h) is where every further
    term is exactly 0.0 in double arithmetic, so the result is exact.
    A smaller ``reach`` (in bandwidths) is an explicit opt-in that trades
    a relative error of about exp(-reach^2 / 2) for (38.7 / reach)^2 fewer
    point-cell pairs in dense areas.
    """
    pts = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull() & F.col(time_col).isNotNull())
    if last_hours is not None:
        tmax = pts.agg(F.max(time_col)).scalar()
        pts = pts.where(F.col(time_col) >= tmax - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                                     F.lit(float(last_hours) * 3600)))
    pts = project(pts, lon, lat, "_px", "_py").groupBy("_px", "_py").agg(F.count(F.lit(1)).alias("_w"))
    n_pts = pts.agg(F.sum("_w")).scalar()
    reach = float(reach) * float(bandwidth)
    off = F.sequence(F.lit(-1), F.lit(1))
    # a bucket is as wide as a city: its points are dealt to several tasks
    salt = F.pmod(F.xxhash64("_px", "_py"), F.lit(KDE_SALTS)).cast("int")
    P = (pts.withColumns({"_salt": salt, "_bx": F.floor(F.col("_px") / reach), "_by": F.floor(F.col("_py") / reach)}))
    C = (cells.select("cell_id", "cx", "cy",
                      F.floor(F.col("cx") / reach).alias("_cbx"), F.floor(F.col("cy") / reach).alias("_cby"))
         .withColumn("_ox", F.explode(off)).withColumn("_oy", F.explode(off))
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(KDE_SALTS - 1))))
         .select("cell_id", "cx", "cy", "_salt", (F.col("_cbx") + F.col("_ox")).alias("_bx"),
                 (F.col("_cby") + F.col("_oy")).alias("_by")))
    h2 = 2.0 * float(bandwidth) ** 2
    contrib = (C.join(P, ["_bx", "_by", "_salt"])
               .select("cell_id", (F.col("_w") * F.exp(-(F.pow(F.col("cx") - F.col("_px"), 2)
                                                        + F.pow(F.col("cy") - F.col("_py"), 2)) / h2))
                       .alias("_k"))
               .groupBy("cell_id").agg(F.sum("_k").alias("_s")))
    dens = (cells.select("cell_id").join(contrib, "cell_id", "left")
            .select("cell_id", (F.coalesce(F.col("_s"), F.lit(0.0))
                                / (n_pts * F.lit(math.pi * h2))).alias("kde_raw")))
    return minmax_scale(dens, "kde_raw", "kde_score").withColumn(
        "kde_score", F.when(F.coalesce(n_pts, F.lit(0)) > 0, F.col("kde_score")).otherwise(F.lit(0.0)))


def minmax_scale(df: DataFrame, col: str, out: str, eps: float = 1e-9) -> DataFrame:
    """(v - min) / (max - min + eps) with min/max as scalar subqueries."""
    mm = df.select(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    return df.withColumn(out, (F.col(col) - mm["lo"]) / (mm["hi"] - mm["lo"] + F.lit(eps)))


# ------------------------------------------------------------ P14, P15

def knn_cells(cells: DataFrame, k: int = 8, prob: str = "combined_prob_24h",
              anchors: DataFrame | None = None) -> DataFrame:
    """For every anchor cell of a full grid, its ``k`` nearest cells by
    centroid distance (the anchor itself first), ties broken by higher
    ``prob`` then ``cell_id``.  Exact: with m = ceil(sqrt k) - 1, an
    (m+1) x (m+1) block of cells within m*sqrt2 cells exists next to every
    anchor once both grid sides have >= m+1 cells, so the k-th distance is
    <= floor(m*sqrt2) cells; narrower grids search k cells out.  Each
    anchor's candidate set is bounded by the search square."""
    m = math.ceil(math.sqrt(k)) - 1
    r_wide = max(1, int(math.floor(m * math.sqrt(2.0))))
    ext = cells.agg(F.least(F.max("ix") + 1, F.max("iy") + 1).alias("w")).scalar()
    radius = F.when(ext >= m + 1, F.lit(r_wide)).otherwise(F.lit(k))
    a = (anchors if anchors is not None else cells).select(
        F.col("cell_id").alias("anchor_id"), F.col("ix").alias("_aix"), F.col("iy").alias("_aiy"),
        F.col("cx").alias("_acx"), F.col("cy").alias("_acy"))
    rng = F.sequence(-radius, radius)
    a = (a.withColumn("_dx", F.explode(rng)).withColumn("_dy", F.explode(rng))
          .select("anchor_id", "_acx", "_acy", (F.col("_aix") + F.col("_dx")).alias("ix"),
                  (F.col("_aiy") + F.col("_dy")).alias("iy")))
    c = cells.select("cell_id", "ix", "iy", "cx", "cy", "lon", "lat",
                     F.coalesce(F.col(prob), F.lit(0.0)).alias("prob"))
    j = a.join(c, ["ix", "iy"]).withColumn("dist_m", planar_m("_acx", "_acy", "cx", "cy"))
    w = W.partitionBy("anchor_id").orderBy(F.col("dist_m"), F.col("prob").desc(), F.col("cell_id"))
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
             .select("anchor_id", "rank", "cell_id", "dist_m", "prob", "cx", "cy", "lon", "lat"))


def nearest_neighbour_routes(knn: DataFrame) -> DataFrame:
    """Greedy nearest-neighbour visiting order over each anchor's
    candidate cells, starting at the first (rank 1).  The per-anchor list
    is bounded by ``k``; the loop is an ``aggregate`` HOF, so all anchors
    are routed in parallel inside the JVM.  Output: one row per stop."""
    pts = knn.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "cell_id", "cx", "cy", "lon", "lat"))).alias("pts"))
    n = F.size("pts")
    first = F.element_at("pts", 1)
    init = F.struct(F.array(first).alias("route"), F.slice("pts", F.lit(2), F.greatest(F.size("pts"), F.lit(1))).alias("rest"),
                    first.alias("cur"))

    def step(st, _i):
        cand = F.transform(st["rest"], lambda r, j: F.struct(
            (F.pow(r["cx"] - st["cur"]["cx"], 2) + F.pow(r["cy"] - st["cur"]["cy"], 2)).alias("d"),
            j.alias("pos")))
        best = F.array_min(cand)["pos"]
        nxt = F.element_at(st["rest"], best + 1)
        rest = F.filter(st["rest"], lambda r, j: j != best)
        return F.struct(F.concat(st["route"], F.array(nxt)).alias("route"), rest.alias("rest"),
                        nxt.alias("cur"))

    routed = pts.select("anchor_id", F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                                                 init, lambda st, i: F.when(F.size(st["rest"]) > 0,
                                                                            step(st, i)).otherwise(st))
                        ["route"].alias("route"))
    return routed.select("anchor_id", F.posexplode("route").alias("stop", "p")).select(
        "anchor_id", (F.col("stop") + 1).alias("stop"), F.col("p.cell_id").alias("cell_id"),
        F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
