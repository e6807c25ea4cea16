"""Registered queries: each runs one operator (or job) over the whole
fixture views derived from the driver's tables, paired with ANSI SQL that
DuckDB runs on the same Parquet files.

Output conventions shared by both sides so that results compare exactly:
timestamps as ``yyyy-MM-dd HH:mm:ss`` text, counts as BIGINT, doubles
rounded to 6 decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import (CALLS_SQL, INCIDENTS_SQL, RAW_INCIDENTS_SQL, calls_view, incidents_view,
                                raw_incidents_view)
from ..operators import normalize as N
from ..operators import spatial as S
from ..operators import timecell as T
from ..operators import filters as FL
from ..operators import aggregates as G
from ..operators import graph_build as B
from ..functions.privacy import hash_id
from ..functions.text import split_list

SALT = "vigila-fixture-salt"
CELL = 500.0


def ts_text(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def r6(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def _sql_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# ------------------------------------------------------------ shared plans

def clean_incidents_df(spark, sf):
    return N.clean_incidents(N.normalize_incidents(incidents_view(spark, sf)))


def clean_calls_df(spark, sf):
    return N.clean_calls(N.normalize_calls(calls_view(spark, sf)))


def assigned_incidents(spark, sf, cell=CELL):
    pts = S.project(clean_incidents_df(spark, sf))
    pts = pts.where(F.col("x").isNotNull())
    spec = S.grid_spec(pts, cell)
    return S.assign_cells(pts, spec), spec


def counts_df(spark, sf):
    a, _ = assigned_incidents(spark, sf)
    return T.timecell_counts(a)


# SQL building blocks ---------------------------------------------------

SQL_INCIDENT = f"incident as ({INCIDENTS_SQL})"
SQL_CALL = f"call_rec as ({CALLS_SQL})"
SQL_RAW = f"raw as ({RAW_INCIDENTS_SQL})"
SQL_PTS = """
pts as (select *, 6378137.0 * radians(longitude) as x,
               6378137.0 * ln(tan(pi()/4 + radians(latitude)/2)) as y
        from incident where date_time is not null),
spec as (select min(x) as minx, min(y) as miny from pts),
assigned as (select pts.*, cast(floor((x - minx)/500.0) as bigint) as ix,
                    cast(floor((y - miny)/500.0) as bigint) as iy,
                    'cell_' || cast(floor((x - minx)/500.0) as bigint) || '_' ||
                    cast(floor((y - miny)/500.0) as bigint) as cell_id
             from pts, spec),
counts as (select cell_id, date_trunc('day', date_time) as time_bin, count(*) as crime_count
           from assigned group by 1, 2)
"""


def _with(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts)


# ------------------------------------------------------------------ queries

def q_clean_incidents(spark, sf):
    d = clean_incidents_df(spark, sf)
    return d.select("fir_id", ts_text("date_time").alias("date_time"), "crime_type",
                    r6("latitude").alias("latitude"), r6("longitude").alias("longitude"),
                    F.col("accused_list").alias("accused"))


SQL_clean_incidents = _with(SQL_INCIDENT) + f"""
select fir_id, {_sql_ts('date_time')} as date_time, trim(lower(crime_type)) as crime_type,
       round(latitude, 6) as latitude, round(longitude, 6) as longitude, accused
from incident where date_time is not null"""


def q_clean_raw_incidents(spark, sf):
    """Duplicates, bad times, lists of names: the first report of each id."""
    d = N.clean_incidents(N.normalize_incidents(raw_incidents_view(spark, sf)), order="seq")
    return d.select("fir_id", "seq", ts_text("date_time").alias("date_time"), "crime_type",
                    r6("latitude").alias("latitude"), r6("longitude").alias("longitude"),
                    F.array_join(split_list("accused_list"), "+").alias("accused"),
                    F.col("victim_list").alias("victim"))


SQL_clean_raw_incidents = _with(SQL_RAW) + """
select fir_id, seq, date_time, trim(lower(crime_type)) as crime_type,
       round(try_cast(latitude as double), 6) as latitude, round(longitude, 6) as longitude,
       list_aggregate(list_filter(list_transform(string_split(accused, ';'), lambda x: trim(x)), lambda x: x <> ''),
                      'string_agg', '+') as accused, victim
from (select *, row_number() over (partition by fir_id order by seq) as nth from raw)
where nth = 1 and try_cast(date_time as timestamp) is not null"""


def q_fill_defaults(spark, sf):
    """Null numbers become 0, null texts 'unk'."""
    d = N.normalize_incidents(raw_incidents_view(spark, sf)).select("seq", "crime_type", "latitude", "accused_list", "victim_list")
    return N.fill_defaults(d).select("seq", "crime_type", r6("latitude").alias("latitude"),
                                     F.col("accused_list").alias("accused"), F.col("victim_list").alias("victim"))


SQL_fill_defaults = _with(SQL_RAW) + """
select seq, crime_type, round(coalesce(try_cast(latitude as double), 0), 6) as latitude,
       coalesce(accused, 'unk') as accused, coalesce(victim, 'unk') as victim from raw"""


def q_case_graph_edges(spark, sf):
    """B1, B2: people of a case, each list member an edge, victims too."""
    inc = N.clean_incidents(N.normalize_incidents(raw_incidents_view(spark, sf)), order="seq")
    _, e = B.case_graph(inc, SALT)
    return e.groupBy("relation", "dst").agg(F.count_distinct("src").alias("n_people"))


SQL_case_graph_edges = _with(SQL_RAW) + """,
one as (select * from (select *, row_number() over (partition by fir_id order by seq) as nth from raw)
        where nth = 1 and try_cast(date_time as timestamp) is not null),
m as (select 'CO_OFFEND' as relation, fir_id, trim(unnest(string_split(accused, ';'))) as p from one
      union all select 'INVOLVED_IN', fir_id, trim(unnest(string_split(victim, ';'))) from one)
select relation, 'Case::' || fir_id as dst, count(distinct p) as n_people from m where p <> '' group by 1, 2"""


def q_clean_calls(spark, sf):
    d = clean_calls_df(spark, sf)
    return d.select("cdr_id", "caller_id", "receiver_id", ts_text("start_time").alias("start_time"),
                    r6("duration_seconds").alias("duration_seconds"),
                    r6("tower_lat").alias("tower_lat"), r6("tower_lon").alias("tower_lon"))


SQL_clean_calls = _with(SQL_CALL) + f"""
select cdr_id, caller_id, receiver_id, {_sql_ts('start_time')} as start_time,
       round(duration_seconds, 6) as duration_seconds, round(tower_lat, 6) as tower_lat,
       round(tower_lon, 6) as tower_lon
from call_rec where start_time is not null"""


def q_anonymise_calls(spark, sf):
    d = clean_calls_df(spark, sf)
    return d.select("cdr_id", hash_id("caller_id", SALT).alias("caller_id"),
                    hash_id("receiver_id", SALT).alias("receiver_id"))


SQL_anonymise_calls = _with(SQL_CALL) + f"""
select cdr_id, substr(sha256(caller_id || '{SALT}'), 1, 16) as caller_id,
       substr(sha256(receiver_id || '{SALT}'), 1, 16) as receiver_id
from call_rec where start_time is not null"""


def q_grid_assign(spark, sf):
    a, _ = assigned_incidents(spark, sf)
    return a.select("fir_id", "cell_id", F.col("ix").cast("long").alias("ix"),
                    F.col("iy").cast("long").alias("iy"))


SQL_grid_assign = _with(SQL_INCIDENT, SQL_PTS) + """
select fir_id, cell_id, ix, iy from assigned"""


def q_grid_cells(spark, sf):
    pts = S.project(clean_incidents_df(spark, sf)).where(F.col("x").isNotNull())
    cells = S.grid_cells(S.grid_spec(pts, CELL))
    return cells.select("cell_id", "ix", "iy", r6("lon").alias("lon"), r6("lat").alias("lat"))


SQL_grid_cells = _with(SQL_INCIDENT, SQL_PTS) + """,
b as (select min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from pts),
n as (select *, cast(floor((maxx-minx)/500.0) as bigint) + 1 as nx,
             cast(floor((maxy-miny)/500.0) as bigint) + 1 as ny from b),
c as (select ix, iy, minx + ix*500.0 + 250.0 as cx, miny + iy*500.0 + 250.0 as cy
      from n, range(0, n.nx) r1(ix), range(0, n.ny) r2(iy))
select 'cell_' || ix || '_' || iy as cell_id, ix, iy,
       round(degrees(cx / 6378137.0), 6) as lon,
       round(degrees(2 * atan(exp(cy / 6378137.0)) - pi()/2), 6) as lat
from c"""


def q_grid_counts(spark, sf):
    c = counts_df(spark, sf)
    return c.select("cell_id", ts_text("time_bin").alias("time_bin"), "crime_count")


SQL_grid_counts = _with(SQL_INCIDENT, SQL_PTS) + f"""
select cell_id, {_sql_ts('time_bin')} as time_bin, crime_count from counts"""


def q_cell_counts(spark, sf):
    a, _ = assigned_incidents(spark, sf)
    return T.cell_counts(a)


SQL_cell_counts = _with(SQL_INCIDENT, SQL_PTS) + """
select cell_id, count(*) as n_incidents from assigned group by 1"""


def q_history_windows(spark, sf):
    h = T.history_features(counts_df(spark, sf))
    return h.select("cell_id", ts_text("time_bin").alias("time_bin"), "crime_count",
                    *[F.col(f"hist_{w}d").cast("long").alias(f"hist_{w}d") for w in T.HISTORY_WINDOWS],
                    F.col("hour").cast("long").alias("hour"), F.col("weekday").cast("long").alias("weekday"))


SQL_history_windows = _with(SQL_INCIDENT, SQL_PTS) + f"""
select cell_id, {_sql_ts('time_bin')} as time_bin, crime_count,
  cast(sum(crime_count) over (partition by cell_id order by time_bin
       range between interval 1 day preceding and current row) as bigint) as hist_1d,
  cast(sum(crime_count) over (partition by cell_id order by time_bin
       range between interval 3 day preceding and current row) as bigint) as hist_3d,
  cast(sum(crime_count) over (partition by cell_id order by time_bin
       range between interval 7 day preceding and current row) as bigint) as hist_7d,
  cast(sum(crime_count) over (partition by cell_id order by time_bin
       range between interval 14 day preceding and current row) as bigint) as hist_14d,
  cast(hour(time_bin) as bigint) as hour, cast(isodow(time_bin) - 1 as bigint) as weekday
from counts"""


def q_lead_labels(spark, sf):
    lab = T.lead_labels(counts_df(spark, sf))
    return lab.select("cell_id", ts_text("time_bin").alias("time_bin"), F.col("label").cast("long").alias("label"))


SQL_lead_labels = _with(SQL_INCIDENT, SQL_PTS) + f"""
select a.cell_id, {_sql_ts('a.time_bin')} as time_bin,
       cast(case when b.cell_id is null then 0 else 1 end as bigint) as label
from counts a left join counts b
  on a.cell_id = b.cell_id and b.time_bin = a.time_bin + interval 24 hour and b.crime_count > 0"""


def q_horizon_labels(spark, sf):
    lab = T.horizon_labels(counts_df(spark, sf))
    return lab.select("cell_id", ts_text("time_bin").alias("time_bin"), F.col("label_7d").cast("long").alias("label_7d"))


SQL_horizon_labels = _with(SQL_INCIDENT, SQL_PTS) + f"""
select a.cell_id, {_sql_ts('a.time_bin')} as time_bin,
       cast(case when exists (select 1 from counts b where b.cell_id = a.cell_id
            and b.time_bin > a.time_bin and b.time_bin <= a.time_bin + interval 7 day)
            then 1 else 0 end as bigint) as label_7d
from counts a where a.time_bin + interval 7 day <= (select max(time_bin) from counts)"""


FILTER_TYPES = ["error"]
FILTER_DATES = ("2024-01-05", "2024-01-20")
FILTER_BBOX = (77.01, 28.51, 77.09, 28.59)


def q_filters(spark, sf):
    d = FL.filter_incidents(clean_incidents_df(spark, sf), FILTER_TYPES, FILTER_DATES, FILTER_BBOX)
    return d.select("fir_id", "crime_type", ts_text("date_time").alias("date_time"))


SQL_filters = _with(SQL_INCIDENT) + f"""
select fir_id, crime_type, {_sql_ts('date_time')} as date_time from incident
where date_time is not null and crime_type in ('error')
  and date_time >= timestamp '2024-01-05' and date_time < timestamp '2024-01-21'
  and longitude > 77.01 and longitude < 77.09 and latitude > 28.51 and latitude < 28.59"""


def q_call_filters(spark, sf):
    d = FL.filter_calls(clean_calls_df(spark, sf), FILTER_DATES, FILTER_BBOX)
    return d.select("cdr_id", ts_text("start_time").alias("start_time"))


SQL_call_filters = _with(SQL_CALL) + f"""
select cdr_id, {_sql_ts('start_time')} as start_time from call_rec
where start_time is not null
  and start_time >= timestamp '2024-01-05' and start_time < timestamp '2024-01-21'
  and tower_lon > 77.01 and tower_lon < 77.09 and tower_lat > 28.51 and tower_lat < 28.59"""


def q_top_hotspots(spark, sf):
    a, _ = assigned_incidents(spark, sf)
    return G.top_k(T.cell_counts(a), "n_incidents", 10, "cell_id")


SQL_top_hotspots = _with(SQL_INCIDENT, SQL_PTS) + """
select cell_id, count(*) as n_incidents from assigned group by 1
order by n_incidents desc, cell_id limit 10"""


def q_latest_bin(spark, sf):
    c = FL.latest_bin(counts_df(spark, sf))
    return c.select("cell_id", ts_text("time_bin").alias("time_bin"), "crime_count")


SQL_latest_bin = _with(SQL_INCIDENT, SQL_PTS) + f"""
select cell_id, {_sql_ts('time_bin')} as time_bin, crime_count from counts
where time_bin = (select max(time_bin) from counts)"""


def q_call_matches(spark, sf):
    m = S.call_incident_matches(clean_calls_df(spark, sf), clean_incidents_df(spark, sf))
    return m.select("fir_id", "cdr_id", r6("time_diff_minutes").alias("time_diff_minutes"),
                    r6("distance_m").alias("distance_m"))


SQL_MATCH = """
m as (select i.fir_id, c.cdr_id, c.caller_id, c.receiver_id, c.start_time, c.duration_seconds,
        abs(epoch_us(c.start_time) - epoch_us(i.date_time)) / 60000000.0 as time_diff_minutes,
        sqrt(pow(6378137.0 * radians(c.tower_lon) - 6378137.0 * radians(i.longitude), 2) +
             pow(6378137.0 * ln(tan(pi()/4 + radians(c.tower_lat)/2))
                 - 6378137.0 * ln(tan(pi()/4 + radians(i.latitude)/2)), 2)) as distance_m
      from call_rec c, incident i
      where c.start_time between i.date_time - interval 60 minute and i.date_time + interval 60 minute),
mm as (select * from m where time_diff_minutes <= 60 and distance_m <= 500)
"""

SQL_call_matches = _with(SQL_INCIDENT, SQL_CALL, SQL_MATCH) + """
select fir_id, cdr_id, round(time_diff_minutes, 6) as time_diff_minutes,
       round(distance_m, 6) as distance_m from mm"""


def q_call_incident_map(spark, sf):
    r = S.map_calls_to_incidents(clean_calls_df(spark, sf), clean_incidents_df(spark, sf))
    return r.select("fir_id", F.coalesce("start_time_count", F.lit(0)).alias("n_calls"),
                    ts_text("start_time_min").alias("first_call"), ts_text("start_time_max").alias("last_call"),
                    r6("duration_seconds_mean").alias("duration_seconds_mean"),
                    r6("time_diff_minutes_mean").alias("time_diff_minutes_mean"),
                    r6("distance_m_mean").alias("distance_m_mean"))


SQL_call_incident_map = _with(SQL_INCIDENT, SQL_CALL, SQL_MATCH) + f""",
g as (select fir_id, count(cdr_id) as n, min(start_time) as t0, max(start_time) as t1,
             avg(duration_seconds) as d, avg(time_diff_minutes) as td, avg(distance_m) as dm
      from mm group by 1)
select i.fir_id, coalesce(g.n, 0) as n_calls, {_sql_ts('g.t0')} as first_call,
       {_sql_ts('g.t1')} as last_call, round(g.d, 6) as duration_seconds_mean,
       round(g.td, 6) as time_diff_minutes_mean, round(g.dm, 6) as distance_m_mean
from incident i left join g on i.fir_id = g.fir_id where i.date_time is not null"""


def q_quality_counts(spark, sf):
    return N.quality_counts(N.normalize_incidents(raw_incidents_view(spark, sf)), clean_calls_df(spark, sf))


SQL_quality_counts = _with(SQL_RAW, SQL_CALL) + """
select 'FIR' as kind, count(*) as n_rows,
       count(*) filter (where try_cast(date_time as timestamp) is null) as n_null_time,
       count(*) filter (where try_cast(latitude as double) is null or longitude is null) as n_null_geometry
from raw
union all
select 'CDR', count(*), count(*) filter (where start_time is null),
       count(*) filter (where tower_lat is null or tower_lon is null)
from call_rec where start_time is not null"""


def q_crime_types(spark, sf):
    return G.distinct_sorted(clean_incidents_df(spark, sf), "crime_type")


SQL_crime_types = _with(SQL_INCIDENT) + """
select distinct crime_type from incident where crime_type is not null order by 1"""


def q_time_span(spark, sf):
    span = G.time_span((clean_incidents_df(spark, sf), "date_time"), (clean_calls_df(spark, sf), "start_time"))
    return span.select(ts_text("min_time").alias("min_time"), ts_text("max_time").alias("max_time"))


SQL_time_span = _with(SQL_INCIDENT, SQL_CALL) + f""",
u as (select date_time as t from incident union all select start_time from call_rec)
select {_sql_ts('min(t)')} as min_time, {_sql_ts('max(t)')} as max_time from u"""


REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, fn, sql: str | None):
    REGISTRY[name] = (fn, sql)


for _name in ["clean_incidents", "clean_calls", "anonymise_calls", "grid_assign", "grid_cells",
              "grid_counts", "cell_counts", "history_windows", "lead_labels", "horizon_labels",
              "filters", "call_filters", "top_hotspots", "latest_bin", "call_matches",
              "call_incident_map", "quality_counts", "crime_types", "time_span", "clean_raw_incidents",
              "fill_defaults", "case_graph_edges"]:
    register(_name, globals()[f"q_{_name}"], globals()[f"SQL_{_name}"])
