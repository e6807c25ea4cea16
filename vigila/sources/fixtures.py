"""Incident, call and polygon views derived from the driver's tables.

The driver's tables hold no incident reports or call records, so these
deterministic projections of ``events`` (and ``nation``) stand in for them.
Each is a pure projection + filter: no shuffle, and Catalyst prunes the
scan to the columns used and pushes the ``event_type`` filter into Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _coord(event_id, mult: int, mod: int, base: float):
    return F.lit(base) + ((event_id * F.lit(mult)) % F.lit(mod)) / F.lit(float(mod) * 10.0)


def incidents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident reports: fir_id, date_time, crime_type, latitude, longitude, accused."""
    ev = load_table(spark, sf_dir, "events")
    e = F.col("event_id")
    return (ev.where(F.col("event_type").isin("error", "purchase"))
              .select(F.concat(F.lit("I"), e.cast("string")).alias("fir_id"),
                      F.col("ts").alias("date_time"),
                      F.lower(F.trim("event_type")).alias("crime_type"),
                      _coord(e, 7919, 997, 28.5).alias("latitude"),
                      _coord(e, 6101, 991, 77.0).alias("longitude"),
                      F.col("user_id").cast("string").alias("accused")))


def calls_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call records: cdr_id, caller_id, receiver_id, start_time,
    duration_seconds, tower_lat, tower_lon."""
    ev = load_table(spark, sf_dir, "events")
    e, u = F.col("event_id"), F.col("user_id")
    return (ev.where(F.col("event_type").isin("click", "view"))
              .select(F.concat(F.lit("C"), e.cast("string")).alias("cdr_id"),
                      u.cast("string").alias("caller_id"),
                      ((u * 7 + e) % 150).cast("string").alias("receiver_id"),
                      F.col("ts").alias("start_time"),
                      F.col("value").alias("duration_seconds"),
                      _coord(e, 4801, 997, 28.5).alias("tower_lat"),
                      _coord(e, 3307, 991, 77.0).alias("tower_lon")))


def demographics_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One square polygon per nation over the incident area (a 5x5 tiling
    of 0.02-degree boxes from 28.5N 77.0E), with population and density
    taken from the nation key.  Rings are ``array<struct<x,y>>``
    in lon/lat, closed."""
    n = load_table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    col_i = (k % 5).cast("double")
    row_j = F.floor(k / 5).cast("double")
    x0 = F.lit(77.0) + col_i * F.lit(0.02)
    y0 = F.lit(28.5) + row_j * F.lit(0.02)
    x1, y1 = x0 + F.lit(0.02), y0 + F.lit(0.02)

    def pt(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))
    return n.select(F.col("n_name").alias("region"),
                    ((k + 1) * 1000).cast("long").alias("population"),
                    ((k + 1) * 250).cast("long").alias("density"),
                    F.array(ring).alias("rings"))


def raw_incidents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident reports as they arrive: text times, some bad or missing, reports
    that came twice under one fir_id (``seq`` is the order of arrival), names in
    lists, coordinates that are no numbers."""
    base = load_table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    e, u = F.col("event_id"), F.col("user_id")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    lat = _coord(e, 7919, 997, 28.5).cast("decimal(12,6)").cast("string")

    def part(again: bool):
        time = F.when(e % 11 == 0, F.lit("unknown")).when(e % 13 == 0, F.lit(None)).otherwise(stamp)
        return base.where(e % 7 == 0 if again else F.lit(True)).select(
            F.concat(F.lit("I"), e.cast("string")).alias("fir_id"),
            (e * 2 + (1 if again else 0)).alias("seq"), (stamp if again else time).alias("date_time"),
            (F.concat(F.lit("  "), F.upper("event_type")) if again else F.col("event_type")).alias("crime_type"),
            F.when(e % 17 == 0, F.lit("n/a")).otherwise(lat).alias("latitude"),
            _coord(e, 6101, 991, 77.0).alias("longitude"),
            F.when(e % 5 == 0, F.lit(None)).otherwise(F.concat_ws(" ; ", u.cast("string"), (u + 1).cast("string"), F.lit("")))
            .alias("accused"),
            F.when(e % 3 == 0, F.concat(F.lit("V"), u.cast("string"))).alias("victim"))
    return part(False).unionByName(part(True))


RAW_INCIDENTS_SQL = """
select concat('I', cast(event_id as varchar)) as fir_id, event_id * 2 + again as seq,
       case when again = 0 and event_id % 11 = 0 then 'unknown' when again = 0 and event_id % 13 = 0 then null
            else strftime(ts, '%Y-%m-%d %H:%M:%S') end as date_time,
       case when again = 1 then '  ' || upper(event_type) else event_type end as crime_type,
       case when event_id % 17 = 0 then 'n/a' else cast(cast(28.5e0 + ((event_id*7919) % 997)/9970.0e0 as decimal(12,6)) as varchar) end as latitude,
       cast(77.0e0 + ((event_id*6101) % 991)/9910.0e0 as double) as longitude,
       case when event_id % 5 = 0 then null else user_id || ' ; ' || (user_id + 1) || ' ; ' end as accused,
       case when event_id % 3 = 0 then 'V' || user_id end as victim
from events, (values (0), (1)) r(again)
where event_type in ('error','purchase') and (again = 0 or event_id % 7 = 0)"""


# Equivalent SQL (DuckDB and Spark) for the oracle checks.
INCIDENTS_SQL = """
select concat('I', cast(event_id as varchar)) as fir_id, ts as date_time,
       lower(trim(event_type)) as crime_type,
       cast(28.5e0 + ((event_id*7919) % 997)/9970.0e0 as double) as latitude,
       cast(77.0e0 + ((event_id*6101) % 991)/9910.0e0 as double) as longitude,
       cast(user_id as varchar) as accused
from events where event_type in ('error','purchase')
"""

CALLS_SQL = """
select concat('C', cast(event_id as varchar)) as cdr_id,
       cast(user_id as varchar) as caller_id,
       cast((user_id*7+event_id) % 150 as varchar) as receiver_id,
       ts as start_time, value as duration_seconds,
       cast(28.5e0 + ((event_id*4801) % 997)/9970.0e0 as double) as tower_lat,
       cast(77.0e0 + ((event_id*3307) % 991)/9910.0e0 as double) as tower_lon
from events where event_type in ('click','view')
"""
