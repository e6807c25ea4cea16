"""Registered queries for the smaller operators: densified counts, graph
display columns, layer centre, polygon centroids, key checks and hash
sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import ring_centroid
from ..sources.fixtures import demographics_view, load_table, raw_incidents_view
from ..sources.sinks import assert_unique
from ..operators import spatial as S
from ..operators import timecell as T
from ..operators import graph_build as B
from ..operators import graph_algo as GA
from ..operators import aggregates as G
from ..operators import normalize as N
from .queries import (register, clean_calls_df, clean_incidents_df, r6, ts_text, _with, SQL_INCIDENT, SQL_CALL, SQL_PTS, SQL_RAW, SALT,
                      CELL, _sql_ts)
from .graph_queries import fixture_graph, SQL_GRAPH, SQL_DEG


def q_dense_counts(spark, sf):
    inc = clean_incidents_df(spark, sf)
    pts = S.project(inc).where(F.col("x").isNotNull())
    spec = S.grid_spec(pts, CELL)
    counts = T.timecell_counts(S.assign_cells(pts, spec))
    d = T.densify(counts, S.grid_cells(spec))
    return d.select("cell_id", ts_text("time_bin").alias("time_bin"), "crime_count")


SQL_dense_counts = _with(SQL_INCIDENT, SQL_PTS, """
b as (select min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from pts),
n as (select *, cast(floor((maxx-minx)/500.0) as bigint) + 1 as nx,
             cast(floor((maxy-miny)/500.0) as bigint) + 1 as ny from b),
cells as (select 'cell_' || ix || '_' || iy as cell_id from n, range(0, n.nx) r1(ix), range(0, n.ny) r2(iy)),
bins as (select distinct time_bin from counts)""") + f"""
select c.cell_id, {_sql_ts('b.time_bin')} as time_bin, coalesce(k.crime_count, 0) as crime_count
from cells c cross join bins b left join counts k on k.cell_id = c.cell_id and k.time_bin = b.time_bin"""


def q_graph_display(spark, sf):
    n, e, _ = fixture_graph(spark, sf)
    dn, _ = B.display_columns(n, GA.degree(n, e), e)
    return dn.select("id", "label", r6("size").alias("size"), "color")


SQL_graph_display = _with(SQL_INCIDENT, SQL_CALL, SQL_GRAPH, SQL_DEG) + """
select n.id, n.label, round(5.0 + ln(1 + d.degree) * 6, 6) as size,
       case n.label when 'Person' then '#ffcc00' when 'Phone' then '#ff6666' when 'Case' then '#66cc66'
            else '#97c2fc' end as color
from g_nodes n join deg d on d.id = n.id"""


def q_layer_center(spark, sf):
    c = S.layer_center(clean_incidents_df(spark, sf))
    return c.select(r6("lon").alias("lon"), r6("lat").alias("lat"))


SQL_layer_center = _with(SQL_INCIDENT) + """
select round(avg(longitude), 6) as lon, round(avg(latitude), 6) as lat
from (select distinct longitude, latitude from incident
      where date_time is not null and longitude is not null and latitude is not null)"""


def q_polygon_centroids(spark, sf):
    d = demographics_view(spark, sf)
    c = d.select("region", ring_centroid(F.col("rings")[0]).alias("c"))
    return c.select("region", r6("c.x").alias("cx"), r6("c.y").alias("cy"))


SQL_polygon_centroids = """
select n_name as region, round(77.0 + (n_nationkey % 5) * 0.02 + 0.01, 6) as cx,
       round(28.5 + floor(n_nationkey / 5) * 0.02 + 0.01, 6) as cy
from nation"""


def q_duplicate_node_keys(spark, sf):
    """W5 on nodes as they come from the cases, before people are merged."""
    inc = N.clean_incidents(N.normalize_incidents(raw_incidents_view(spark, sf)), order="seq")
    n, _ = B.case_graph(inc, SALT)
    return assert_unique(n, "id").select("id", F.col("count").cast("long").alias("count"))


SQL_duplicate_node_keys = _with(SQL_RAW) + f""",
one as (select * from (select *, row_number() over (partition by fir_id order by seq) as nth from raw)
        where nth = 1 and try_cast(date_time as timestamp) is not null),
m as (select trim(unnest(string_split(accused, ';'))) as p from one
      union all select trim(unnest(string_split(victim, ';'))) from one)
select 'Person::' || substr(sha256(p || '{SALT}'), 1, 20) as id, count(*) as count
from m where p <> '' group by 1 having count(*) > 1"""


def q_edge_sample(spark, sf):
    _, e, _ = fixture_graph(spark, sf)
    from ..operators.links import sample_edges
    return sample_edges(e, 500, 42)


SQL_edge_sample = _with(SQL_INCIDENT, SQL_CALL, SQL_GRAPH, """
ce as (select distinct least(src, dst) as u, greatest(src, dst) as v from g_edges where src <> dst)""") + """
select u, v from ce
order by cast(('0x' || substr(md5('42e:' || u || '|' || v), 1, 15)) as bigint), u, v limit 500"""


def devices_view(spark, sf):
    """Device map from customers: one phone each, some unknown."""
    c = F.col("c_custkey")
    return load_table(spark, sf, "customer").select(
        F.concat(F.lit("IM"), c.cast("string")).alias("imei"),
        F.when(c % 9 != 0, (c % 150).cast("string")).alias("phone_number"))


def locations_view(spark, sf):
    """Locations from suppliers, over the incident area."""
    k = F.col("s_suppkey")
    return load_table(spark, sf, "supplier").select(
        F.concat(F.lit("L"), k.cast("string")).alias("loc_id"), F.col("s_name").alias("name"),
        (F.lit(28.5) + (k * 7919) % 997 / 9970.0).alias("latitude"),
        (F.lit(77.0) + (k * 6101) % 991 / 9910.0).alias("longitude"))


def q_device_edges(spark, sf):
    """Devices and their phones."""
    _, e = B.device_graph(devices_view(spark, sf), SALT)
    return e.select("src", "dst", "relation")


SQL_device_edges = f"""
select 'Device::IM' || c_custkey as src,
       'Phone::' || substr(sha256(cast(c_custkey % 150 as varchar) || '{SALT}'), 1, 20) as dst,
       'ASSOCIATED_WITH' as relation
from customer where c_custkey % 9 <> 0"""


def q_call_devices(spark, sf):
    """Devices named in calls, one edge per call, blank ones left out."""
    c = clean_calls_df(spark, sf)
    h = F.length("cdr_id")
    c = c.withColumn("imei", F.when(h % 2 == 0, F.concat(F.lit("IM"), "caller_id")).otherwise(F.lit(" ")))
    _, e = B.phone_graph(c, SALT)
    return e.groupBy("relation", "src").agg(F.count("*").alias("n"))


SQL_call_devices = _with(SQL_CALL) + f"""
select 'CALLED' as relation, 'Phone::' || substr(sha256(caller_id || '{SALT}'), 1, 20) as src, count(*) as n
from call_rec where start_time is not null group by 2
union all
select 'USED_BY_PHONE', 'Device::IM' || caller_id, count(*)
from call_rec where start_time is not null and length(cdr_id) % 2 = 0 group by 2"""


def q_near_locations(spark, sf):
    """Cases within 200 m of a location."""
    inc = clean_incidents_df(spark, sf)
    e = B.near_location_edges(inc, locations_view(spark, sf), 200.0)
    return e.select("src", "dst", r6("distance_m").alias("distance_m"))


SQL_near_locations = _with(SQL_INCIDENT, """
loc as (select 'Location::L' || s_suppkey as id, 28.5e0 + ((s_suppkey*7919) % 997)/9970.0e0 as lat,
               77.0e0 + ((s_suppkey*6101) % 991)/9910.0e0 as lon from supplier),
pr as (select 'Case::' || fir_id as src, t.id as dst,
         pow(sin(radians(t.lat - i.latitude) / 2), 2)
           + cos(radians(i.latitude)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - i.longitude) / 2), 2) as a
       from incident i, loc t
       where i.date_time is not null and abs(t.lat - i.latitude) < 0.004 and abs(t.lon - i.longitude) < 0.006)""") + """
select src, dst, round(2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)), 6) as distance_m
from pr where 2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)) <= 200.0"""


register("device_edges", q_device_edges, SQL_device_edges)
register("call_devices", q_call_devices, SQL_call_devices)
register("near_locations", q_near_locations, SQL_near_locations)
register("dense_counts", q_dense_counts, SQL_dense_counts)
register("graph_display", q_graph_display, SQL_graph_display)
register("layer_center", q_layer_center, SQL_layer_center)
register("polygon_centroids", q_polygon_centroids, SQL_polygon_centroids)
register("duplicate_node_keys", q_duplicate_node_keys, SQL_duplicate_node_keys)
register("edge_sample", q_edge_sample, SQL_edge_sample)
