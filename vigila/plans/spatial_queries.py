"""Registered spatial queries: point in polygon, distance-threshold joins,
kernel density at cells, k nearest cells and patrol routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixtures import demographics_view
from ..operators import spatial as S
from ..operators import timecell as T
from .queries import (register, clean_incidents_df, clean_calls_df, r6, _with, SQL_INCIDENT,
                      SQL_CALL, SQL_PTS, CELL)

KDE_BANDWIDTH = 1000.0
KDE_HOURS = 72.0
TOWER_RADIUS = 100.0
KNN = 8


def q_pip_join(spark, sf):
    inc = clean_incidents_df(spark, sf)
    j = S.points_in_polygons(inc, demographics_view(spark, sf))
    return j.select("fir_id", "region", "population", "density")


SQL_pip_join = _with(SQL_INCIDENT, """
poly as (select n_name as region, cast((n_nationkey + 1) * 1000 as bigint) as population,
                cast((n_nationkey + 1) * 250 as bigint) as density,
                77.0 + (n_nationkey % 5) * 0.02 as x0, 28.5 + floor(n_nationkey / 5) * 0.02 as y0
         from nation)""") + """
select i.fir_id, p.region, p.population, p.density
from incident i left join poly p
  on i.longitude > p.x0 and i.longitude < p.x0 + 0.02 and i.latitude > p.y0 and i.latitude < p.y0 + 0.02
where i.date_time is not null"""


def _towers(calls):
    return (calls.where(F.col("tower_lat").isNotNull() & F.col("tower_lon").isNotNull())
            .select(F.concat_ws(",", F.col("tower_lat").cast("string"), F.col("tower_lon").cast("string")).alias("id"),
                    F.col("tower_lat").alias("lat"), F.col("tower_lon").alias("lon")).distinct())


def q_near_tower(spark, sf):
    inc = clean_incidents_df(spark, sf).select(F.col("fir_id").alias("id"), F.col("latitude").alias("lat"),
                                               F.col("longitude").alias("lon"))
    towers = _towers(clean_calls_df(spark, sf)).select(
        F.round("lat", 6).alias("tlat"), F.round("lon", 6).alias("tlon"), "id", "lat", "lon")
    p = S.near_pairs(inc, towers.select("id", "lat", "lon"), TOWER_RADIUS, "haversine")
    # incidents and towers are distinct, so pairs are too
    return p.select(F.col("left_id").alias("fir_id"), F.col("right_id").alias("tower"),
                    r6("distance_m").alias("distance_m"))


SQL_near_tower = _with(SQL_INCIDENT, SQL_CALL, """
tw as (select distinct tower_lat as lat, tower_lon as lon from call_rec
       where start_time is not null and tower_lat is not null and tower_lon is not null),
pr as (select i.fir_id, t.lat, t.lon,
         2 * 6371000.0 * atan2(sqrt(pow(sin(radians(t.lat - i.latitude) / 2), 2)
             + cos(radians(i.latitude)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - i.longitude) / 2), 2)),
           sqrt(1 - (pow(sin(radians(t.lat - i.latitude) / 2), 2)
             + cos(radians(i.latitude)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - i.longitude) / 2), 2)))) as d
       from incident i, tw t
       where i.date_time is not null and abs(t.lat - i.latitude) < 0.002 and abs(t.lon - i.longitude) < 0.003)""") + """
select distinct fir_id, cast(lat as varchar) || ',' || cast(lon as varchar) as tower, round(d, 6) as distance_m
from pr where d <= 100.0"""


def q_kde_cells(spark, sf):
    inc = clean_incidents_df(spark, sf)
    pts = S.project(inc).where(F.col("x").isNotNull())
    cells = S.grid_cells(S.grid_spec(pts, CELL))
    k = S.kde_cells(inc, cells, KDE_BANDWIDTH, KDE_HOURS)
    return k.select("cell_id", r6("kde_score").alias("kde_score"))


_KDE_CTES = _with(SQL_INCIDENT, SQL_PTS, """
b as (select min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from pts),
n as (select *, cast(floor((maxx-minx)/500.0) as bigint) + 1 as nx,
             cast(floor((maxy-miny)/500.0) as bigint) + 1 as ny from b),
cells as (select 'cell_' || ix || '_' || iy as cell_id, (minx + ix*500.0) + 250.0 as cx,
                 (miny + iy*500.0) + 250.0 as cy from n, range(0, n.nx) r1(ix), range(0, n.ny) r2(iy)),
recent as (select x, y from pts where date_time >= (select max(date_time) from pts) - interval 72 hour),
dens as (select c.cell_id, coalesce(sum(exp(-(pow(c.cx - r.x, 2) + pow(c.cy - r.y, 2)) / 2000000.0)), 0)
                 / ((select count(*) from recent) * pi() * 2000000.0) as raw
         from cells c left join recent r on true group by c.cell_id)""")

SQL_kde_cells = _KDE_CTES + """
select cell_id, round((raw - (select min(raw) from dens)) /
       ((select max(raw) from dens) - (select min(raw) from dens) + 1e-9), 6) as kde_score
from dens"""


def _grid_with_counts(spark, sf):
    inc = clean_incidents_df(spark, sf)
    pts = S.project(inc).where(F.col("x").isNotNull())
    spec = S.grid_spec(pts, CELL)
    cells = S.grid_cells(spec)
    counts = T.cell_counts(S.assign_cells(pts, spec))
    return cells.join(counts, "cell_id", "left").withColumn("n_incidents", F.coalesce("n_incidents", F.lit(0)))


def q_knn_cells(spark, sf):
    g = _grid_with_counts(spark, sf)
    k = S.knn_cells(g, KNN, prob="n_incidents")
    return k.select("anchor_id", F.col("rank").cast("long").alias("rank"), "cell_id", r6("dist_m").alias("dist_m"))


SQL_knn_cells = _with(SQL_INCIDENT, SQL_PTS, """
b as (select min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from pts),
n as (select *, cast(floor((maxx-minx)/500.0) as bigint) + 1 as nx,
             cast(floor((maxy-miny)/500.0) as bigint) + 1 as ny from b),
cells as (select 'cell_' || ix || '_' || iy as cell_id, (minx + ix*500.0) + 250.0 as cx,
                 (miny + iy*500.0) + 250.0 as cy from n, range(0, n.nx) r1(ix), range(0, n.ny) r2(iy)),
cc as (select cell_id, count(*) as c from assigned group by 1),
g as (select cells.*, coalesce(cc.c, 0) as prob from cells left join cc using (cell_id)),
pairs as (select a.cell_id as anchor_id, c.cell_id, sqrt(pow(a.cx - c.cx, 2) + pow(a.cy - c.cy, 2)) as dist_m,
                 c.prob from g a, g c),
ranked as (select *, row_number() over (partition by anchor_id order by dist_m, prob desc, cell_id) as rank
           from pairs)""") + """
select anchor_id, cast(rank as bigint) as rank, cell_id, round(dist_m, 6) as dist_m from ranked where rank <= 8"""


def q_routes(spark, sf):
    g = _grid_with_counts(spark, sf)
    return S.nearest_neighbour_routes(S.knn_cells(g, KNN, prob="n_incidents")) \
        .select("anchor_id", F.col("stop").cast("long").alias("stop"), "cell_id")


def q_knn_occupied(spark, sf):
    """Nearest occupied cells, with one cell far out, as a record at (0, 0) makes it."""
    from ..operators import sparse_grid as SG
    pts = S.project(clean_incidents_df(spark, sf)).where(F.col("x").isNotNull())
    cells = SG.occupied_cells(pts, S.grid_spec(pts, CELL)).select("cell_id", "ix", "iy", "n")
    far = spark.createDataFrame([("cell_far", -17000, -6000, 1)], cells.schema)
    k = SG.nearest_occupied(cells.unionByName(far), KNN, "n", CELL)
    return k.select("anchor_id", F.col("rank").cast("long").alias("rank"), "cell_id", F.round("dist_m", 3).alias("dist_m"))


SQL_knn_occupied = _with(SQL_INCIDENT, SQL_PTS, """
b as (select min(x) as minx, min(y) as miny from pts),
g as (select 'cell_' || ix || '_' || iy as cell_id, ix * 500.0 as cx, iy * 500.0 as cy, count(*) as n
      from (select cast(floor((x - minx) / 500.0) as bigint) as ix, cast(floor((y - miny) / 500.0) as bigint) as iy
            from pts, b) c group by ix, iy
      union all select 'cell_far', -8500000.0, -3000000.0, 1),
ranked as (select a.cell_id as anchor_id, c.cell_id, sqrt(pow(a.cx - c.cx, 2) + pow(a.cy - c.cy, 2)) as dist_m,
             row_number() over (partition by a.cell_id order by sqrt(pow(a.cx - c.cx, 2) + pow(a.cy - c.cy, 2)),
                                c.n desc, c.cell_id) as rank from g a, g c)""") + """
select anchor_id, cast(rank as bigint) as rank, cell_id, round(dist_m, 3) as dist_m from ranked where rank <= 8"""


register("pip_join", q_pip_join, SQL_pip_join)
register("knn_occupied", q_knn_occupied, SQL_knn_occupied)
register("near_tower", q_near_tower, SQL_near_tower)
register("kde_cells", q_kde_cells, SQL_kde_cells)
register("knn_cells", q_knn_cells, SQL_knn_cells)
register("routes", q_routes, None)


ALERT_THRESHOLD = 0.7


def q_alert_windows(spark, sf):
    """The streaming alert operator applied to the whole incident view as a
    batch: sliding 60/5-minute windows of incidents per cell whose density
    score is at or above the threshold."""
    from ..streaming.alerts import prepare_incidents, alert_counts, grid_parameters
    inc = clean_incidents_df(spark, sf)
    pts = S.project(inc).where(F.col("x").isNotNull())
    spec = S.grid_spec(pts, CELL)
    cells = S.grid_cells(spec)
    grid = S.kde_cells(inc, cells, KDE_BANDWIDTH, KDE_HOURS).withColumnRenamed("kde_score", "combined_prob_24h")
    a = alert_counts(prepare_incidents(inc), grid, grid_parameters(spec), ALERT_THRESHOLD)
    return a.select("cell_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
                    r6("prob").alias("prob"), "n_incidents", "msg")


SQL_alert_windows = _KDE_CTES + """,
kde as (select cell_id, (raw - (select min(raw) from dens)) /
       ((select max(raw) from dens) - (select min(raw) from dens) + 1e-9) as prob from dens),
hot as (select cell_id, prob from kde where prob >= 0.7),
win as (select a.cell_id, h.prob, time_bucket(interval 5 minute, a.date_time) - to_minutes(5 * r.k) as ws
        from assigned a join hot h on h.cell_id = a.cell_id, range(0, 12) r(k))
select cell_id, strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start,
       strftime(ws + interval 60 minute, '%Y-%m-%d %H:%M:%S') as window_end, round(prob, 6) as prob,
       count(*) as n_incidents,
       printf('Emerging hotspot %s prob=%.3f recent_events=%d', cell_id, prob, count(*)) as msg
from win group by cell_id, ws, prob"""

register("alert_windows", q_alert_windows, SQL_alert_windows)
