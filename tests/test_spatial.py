"""Spatial operators against brute force."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigila.operators import spatial as S
from vigila.operators import features as FE
from vigila.sources.fixtures import incidents_view, calls_view
from conftest import SF_SMALL


def test_bucket_join_equals_naive(spark):
    inc = incidents_view(spark, SF_SMALL)
    cal = calls_view(spark, SF_SMALL)
    # widen the window so the tiny fixture has matches in several buckets
    got = S.call_incident_matches(cal, inc, window_minutes=240, max_distance=2000.0)
    got = {(r.fir_id, r.cdr_id) for r in got.collect()}
    c = S.project(cal, "tower_lon", "tower_lat", "cx", "cy")
    i = S.project(inc, "longitude", "latitude", "ix_", "iy_")
    naive = (c.crossJoin(i)
             .where(F.abs(F.unix_micros(F.col("start_time").cast("timestamp"))
                          - F.unix_micros(F.col("date_time").cast("timestamp"))) <= 240 * 60e6)
             .where(F.sqrt(F.pow(F.col("cx") - F.col("ix_"), 2) + F.pow(F.col("cy") - F.col("iy_"), 2)) <= 2000.0))
    want = {(r.fir_id, r.cdr_id) for r in naive.select("fir_id", "cdr_id").collect()}
    assert got == want and len(got) > 0
    plan = S.call_incident_matches(cal, inc)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_near_pairs_haversine_equals_naive(spark):
    inc = incidents_view(spark, SF_SMALL).select(F.col("fir_id").alias("id"), F.col("latitude").alias("lat"),
                                                 F.col("longitude").alias("lon"))
    tw = calls_view(spark, SF_SMALL).select(F.col("cdr_id").alias("id"), F.col("tower_lat").alias("lat"),
                                            F.col("tower_lon").alias("lon"))
    got = {(r.left_id, r.right_id) for r in S.near_pairs(inc, tw, 800.0, "haversine").collect()}
    a = [(r.id, r.lat, r.lon) for r in inc.collect()]
    b = [(r.id, r.lat, r.lon) for r in tw.collect()]

    def hav(la1, lo1, la2, lo2):
        p1, p2 = math.radians(la1), math.radians(la2)
        dp, dl = math.radians(la2 - la1), math.radians(lo2 - lo1)
        h = math.sin(dp / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
        return 6371000.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = {(x[0], y[0]) for x in a for y in b if hav(x[1], x[2], y[1], y[2]) <= 800.0}
    assert got == want and len(want) > 0
    got_deg = {(r.left_id, r.right_id) for r in S.near_pairs(inc, tw, 800.0, "degree").collect()}
    want_deg = {(x[0], y[0]) for x in a for y in b
                if math.hypot(x[1] - y[1], x[2] - y[2]) * 111000.0 <= 800.0}
    assert got_deg == want_deg


def test_point_in_polygon_left_and_strict(spark):
    poly = spark.createDataFrame([("sq", [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]),
                                  ("tri", [[(1.0, 1.0), (3.0, 1.0), (1.0, 3.0), (1.0, 1.0)]])],
                                 "name string, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([("in_both", 1.5, 1.2), ("in_sq", 0.5, 0.5), ("edge", 0.0, 1.0),
                                 ("out", 5.0, 5.0)], "pid string, longitude double, latitude double")
    got = {}
    for r in S.points_in_polygons(pts, poly, bucket_deg=0.7).collect():
        got.setdefault(r.pid, set()).add(r.name)
    assert got == {"in_both": {"sq", "tri"}, "in_sq": {"sq"}, "edge": {None}, "out": {None}}


def test_kde_matches_numpy(spark):
    inc = incidents_view(spark, SF_SMALL)
    pts = S.project(inc).where(F.col("x").isNotNull())
    cells = S.grid_cells(S.grid_spec(pts, 500.0))
    got = {r.cell_id: r.kde_score for r in S.kde_cells(inc, cells, 1000.0, 72.0).collect()}
    p = pts.select("x", "y", "date_time").toPandas()
    p = p[p.date_time >= p.date_time.max() - np.timedelta64(72, "h")]
    c = cells.select("cell_id", "cx", "cy").toPandas()
    d2 = (c.cx.values[:, None] - p.x.values[None, :]) ** 2 + (c.cy.values[:, None] - p.y.values[None, :]) ** 2
    dens = np.exp(-d2 / 2e6).sum(1) / (len(p) * 2 * math.pi * 1e6)
    sc = (dens - dens.min()) / (dens.max() - dens.min() + 1e-9)
    for cid, v in zip(c.cell_id, sc):
        assert got[cid] == pytest.approx(v, abs=1e-9)


def test_knn_and_routes_brute_force(spark):
    inc = incidents_view(spark, SF_SMALL)
    pts = S.project(inc).where(F.col("x").isNotNull())
    cells = S.grid_cells(S.grid_spec(pts, 1500.0)).withColumn("p", (F.abs(F.hash("cell_id")) % 7).cast("double"))
    k = S.knn_cells(cells, 8, prob="p")
    c = cells.toPandas()
    got = {}
    for r in k.collect():
        got.setdefault(r.anchor_id, []).append((r.rank, r.cell_id))
    for _, a in c.iterrows():
        d = np.hypot(c.cx - a.cx, c.cy - a.cy)
        order = sorted(zip(d, -c.p, c.cell_id))[:8]
        assert [x[2] for x in order] == [cid for _, cid in sorted(got[a.cell_id])]
    routes = S.nearest_neighbour_routes(k).collect()
    by = {}
    for r in routes:
        by.setdefault(r.anchor_id, []).append((r.stop, r.cell_id))
    pos = {r.cell_id: (r.cx, r.cy) for r in cells.collect()}
    for anchor, stops in list(by.items())[:20]:
        cand = [cid for _, cid in sorted(got[anchor])]
        cur, rest, order = cand[0], cand[1:], [cand[0]]
        while rest:
            nxt = min(rest, key=lambda z: (pos[z][0] - pos[cur][0]) ** 2 + (pos[z][1] - pos[cur][1]) ** 2)
            order.append(nxt); rest.remove(nxt); cur = nxt
        assert [cid for _, cid in sorted(stops)] == order


def test_exact_median(spark):
    vals = [float(v) for v in np.random.default_rng(1).integers(0, 1000, 5001)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double")
    assert FE.exact_median(df, "v") == pytest.approx(float(np.median(vals)))
    df2 = spark.createDataFrame([(v,) for v in vals[:4000]], "v double")
    assert FE.exact_median(df2, "v") == pytest.approx(float(np.median(vals[:4000])))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_theta_joins_plan_no_nested_loop(spark):
    from vigila.sources.fixtures import demographics_view
    inc = incidents_view(spark, SF_SMALL)
    cal = calls_view(spark, SF_SMALL)
    pip = S.points_in_polygons(inc, demographics_view(spark, SF_SMALL))
    a = inc.select(F.col("fir_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    b = cal.select(F.col("cdr_id").alias("id"), F.col("tower_lat").alias("lat"), F.col("tower_lon").alias("lon"))
    pts = S.project(inc).where(F.col("x").isNotNull())
    cells = S.grid_cells(S.grid_spec(pts, 500.0))
    for df in [pip, S.near_pairs(a, b, 100.0, "haversine"), S.near_pairs(a, b, 100.0, "degree"),
               S.near_pairs(a, b, 100.0, "mercator"), S.kde_cells(inc, cells),
               S.knn_cells(cells.withColumn("p", F.lit(0.0)), 8, "p")]:
        p = _plan(df)
        assert "NestedLoop" not in p and "Cartesian" not in p, p[:2000]


def test_medians_of_several_columns_at_once(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b) if i % 3 else None, 7.0 if i % 2 else float("nan"), None)
            for i, (a, b) in enumerate(zip(rng.normal(size=2001), rng.integers(0, 5, 2001)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = FE.exact_medians(df, ["a", "b", "c", "d"])
    assert got["a"] == pytest.approx(np.median([r[0] for r in rows]))
    assert got["b"] == pytest.approx(np.median([r[1] for r in rows if r[1] is not None]))
    assert got["c"] == 7.0 and got["d"] is None
    assert FE.exact_medians(df.limit(0), ["a"]) == {"a": None} and FE.exact_medians(df, []) == {}


def test_a_reach_touches_two_buckets_an_axis(spark):
    at = spark.range(2000).select((F.rand(1) * 1e5).alias("x"))
    n = at.select(F.size(S._buckets_near(F.col("x"), F.lit(500.0))).alias("n")).agg(F.avg("n"), F.max("n")).first()
    assert n[0] < 2.1 and n[1] <= 3


def test_matches_at_the_limits(spark):
    """Pairs that lie exactly at the window's and the radius' ends, and a radius of 0."""
    t0 = dt.datetime(2024, 1, 1, 12)
    cal = spark.createDataFrame([(f"C{m}", t0 + dt.timedelta(minutes=m), 28.5, 77.0) for m in (-61, -60, 0, 59, 60, 61)],
                                "cdr_id string, start_time timestamp_ntz, tower_lat double, tower_lon double")
    cal = cal.withColumns({"caller_id": F.lit("a"), "receiver_id": F.lit("b"), "duration_seconds": F.lit(1.0)})
    inc = spark.createDataFrame([("I0", t0, 28.5, 77.0)], "fir_id string, date_time timestamp_ntz, latitude double, longitude double")
    for radius in (0.0, 500.0):
        for metric in ("mercator", "haversine"):
            got = S.call_incident_matches(cal, inc, 60, radius, metric).select("cdr_id").collect()
            assert sorted(r[0] for r in got) == ["C-60", "C0", "C59", "C60"]


def test_near_pairs_with_radius_zero(spark):
    pts = spark.createDataFrame([("a", 28.5, 77.0), ("b", 28.6, 77.0)], "id string, lat double, lon double")
    for metric in ("haversine", "degree", "mercator"):
        got = S.near_pairs(pts, pts, 0.0, metric).select("left_id", "right_id").collect()
        assert sorted(map(tuple, got)) == [("a", "a"), ("b", "b")]


def test_near_tower_shuffles_no_pairs(spark):
    from vigila.plans.spatial_queries import q_near_tower
    plan = q_near_tower(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]
