"""Registered feature, model and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial as S
from ..operators import timecell as T
from ..operators import features as FE
from ..operators import models as M
from ..operators import aggregates as G
from .queries import (register, clean_incidents_df, clean_calls_df, counts_df, r6, ts_text, _with,
                      SQL_INCIDENT, SQL_CALL, SQL_PTS, SQL_MATCH, CELL, _sql_ts)

SEQ = 7
LAGS = [f"lag_{k}" for k in range(1, SEQ + 1)]


def q_lag_sequences(spark, sf):
    s = T.lag_sequences(counts_df(spark, sf), SEQ)
    return s.select("cell_id", ts_text("time_bin").alias("time_bin"), *LAGS, "target")


_lag_joins = "\n".join(
    f"left join cb l{k} on l{k}.cell_id = g.cell_id and l{k}.bin_no = g.pos - {k}" for k in range(1, SEQ + 1))
_lag_cols = ", ".join(f"cast(coalesce(l{k}.crime_count, 0) as bigint) as lag_{k}" for k in range(1, SEQ + 1))
_lag_sum = " + ".join(f"lag_{k}" for k in range(1, SEQ + 1))

SQL_lag_sequences = _with(SQL_INCIDENT, SQL_PTS, f"""
bins as (select time_bin, row_number() over (order by time_bin) - 1 as bin_no
         from (select distinct time_bin from counts)),
cb as (select c.cell_id, b.bin_no, c.crime_count from counts c join bins b on b.time_bin = c.time_bin),
cellset as (select distinct cell_id from counts),
g as (select c.cell_id, b.bin_no as pos, b.time_bin from cellset c, bins b where b.bin_no >= {SEQ}),
v as (select g.cell_id, g.time_bin, {_lag_cols}, cast(coalesce(t.crime_count, 0) as bigint) as target
      from g left join cb t on t.cell_id = g.cell_id and t.bin_no = g.pos
      {_lag_joins})""") + f"""
select cell_id, {_sql_ts('time_bin')} as time_bin, {', '.join(LAGS)}, target from v
where target + {_lag_sum} > 0"""


def _cells_and_counts(spark, sf):
    inc = clean_incidents_df(spark, sf)
    pts = S.project(inc).where(F.col("x").isNotNull())
    spec = S.grid_spec(pts, CELL)
    return S.grid_cells(spec), T.timecell_counts(S.assign_cells(pts, spec))


def latest_features_df(spark, sf):
    cells, counts = _cells_and_counts(spark, sf)
    latest = counts.agg(F.max("time_bin")).scalar()
    return M.features_at(counts, cells, latest)


def q_latest_features(spark, sf):
    f = latest_features_df(spark, sf)
    return f.select("cell_id", *[F.col(c).cast("long").alias(c) for c in M.BASE_FEATURES])


SQL_CELLS = """
b as (select min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from pts),
n as (select *, cast(floor((maxx-minx)/500.0) as bigint) + 1 as nx,
             cast(floor((maxy-miny)/500.0) as bigint) + 1 as ny from b),
cells as (select 'cell_' || ix || '_' || iy as cell_id from n, range(0, n.nx) r1(ix), range(0, n.ny) r2(iy)),
lt as (select max(time_bin) as t from counts),
h as (select cell_id,
        sum(case when time_bin >= (select t from lt) - interval 1 day then crime_count else 0 end) as hist_1d,
        sum(case when time_bin >= (select t from lt) - interval 3 day then crime_count else 0 end) as hist_3d,
        sum(case when time_bin >= (select t from lt) - interval 7 day then crime_count else 0 end) as hist_7d,
        sum(case when time_bin >= (select t from lt) - interval 14 day then crime_count else 0 end) as hist_14d
      from counts group by 1),
lf as (select c.cell_id, cast(coalesce(h.hist_1d, 0) as bigint) as hist_1d,
              cast(coalesce(h.hist_3d, 0) as bigint) as hist_3d, cast(coalesce(h.hist_7d, 0) as bigint) as hist_7d,
              cast(coalesce(h.hist_14d, 0) as bigint) as hist_14d,
              cast(hour((select t from lt)) as bigint) as hour, cast(isodow((select t from lt)) - 1 as bigint) as weekday
       from cells c left join h on h.cell_id = c.cell_id)
"""

SQL_latest_features = _with(SQL_INCIDENT, SQL_PTS, SQL_CELLS) + """
select cell_id, hist_1d, hist_3d, hist_7d, hist_14d, hour, weekday from lf"""


def q_zscore_contrib(spark, sf):
    f = latest_features_df(spark, sf)
    z = FE.zscore_contributions(f, M.BASE_FEATURES, 6)
    return z.select("cell_id", F.col("rank").cast("long").alias("rank"), "feature",
                    r6("importance").alias("importance"), r6("local_value").alias("local_value"))


_feats = M.BASE_FEATURES
_z_union = "\nunion all\n".join(
    f"select cell_id, '{c}' as feature, cast({c} as double) as local_value, "
    f"abs(({c} - (select avg({c}) from lf)) / (coalesce((select stddev_samp({c}) from lf), 0) + 1e-9)) as importance "
    f"from lf" for c in _feats)

SQL_zscore_contrib = _with(SQL_INCIDENT, SQL_PTS, SQL_CELLS, f"zl as ({_z_union})") + """
select cell_id, rank, feature, round(importance, 6) as importance, round(local_value, 6) as local_value
from (select *, cast(row_number() over (partition by cell_id order by importance desc, feature) as bigint) as rank
      from zl) where rank <= 6"""


def q_drilldown(spark, sf):
    f = latest_features_df(spark, sf)
    return FE.drilldown(f).select("cell_id", "feature", r6("value").alias("value"))


SQL_drilldown = _with(SQL_INCIDENT, SQL_PTS, SQL_CELLS) + "\n" + "\nunion all\n".join(
    f"select cell_id, '{c}' as feature, round(cast({c} as double), 6) as value from lf" for c in _feats)


def q_incident_features(spark, sf):
    mapped = S.map_calls_to_incidents(clean_calls_df(spark, sf), clean_incidents_df(spark, sf))
    f = FE.incident_features(mapped)
    cats = sorted([c for c in f.columns if c.startswith("cat_")], key=lambda c: int(c.split("_")[1]))
    return f.select("fir_id", *[r6(c).alias(c) for c in FE.NUMERIC_FEATURES], *cats)


_num = FE.NUMERIC_FEATURES
SQL_incident_features = _with(SQL_INCIDENT, SQL_CALL, SQL_MATCH, f"""
g as (select fir_id, avg(duration_seconds) as duration_seconds_mean,
             avg(time_diff_minutes) as time_diff_minutes_mean, avg(distance_m) as distance_m_mean
      from mm group by 1),
base as (select i.fir_id, i.crime_type, g.duration_seconds_mean, g.time_diff_minutes_mean, g.distance_m_mean,
                cast(hour(i.date_time) as double) as hour, cast(isodow(i.date_time) - 1 as double) as dayofweek
         from incident i left join g on g.fir_id = i.fir_id where i.date_time is not null),
imp as (select fir_id, crime_type,
  {', '.join(f"coalesce({c}, (select median({c}) from base)) as {c}" for c in _num)} from base),
sc as (select fir_id, crime_type,
  {', '.join(f"({c} - (select avg({c}) from imp)) / (case when coalesce((select stddev_pop({c}) from imp), 0) = 0 then 1.0 else (select stddev_pop({c}) from imp) end) as {c}" for c in _num)}
  from imp)""") + f"""
select fir_id, {', '.join(f"round({c}, 6) as {c}" for c in _num)},
       case when crime_type = 'error' then 1.0 else 0.0 end as cat_0,
       case when crime_type = 'purchase' then 1.0 else 0.0 end as cat_1,
       1.0 as cat_2, 1.0 as cat_3
from sc"""


def forecast_df(spark, sf):
    return M.hotspot_forecast(clean_incidents_df(spark, sf), CELL, SEQ)


def q_hotspot_forecast(spark, sf):
    g = forecast_df(spark, sf)["grid"]
    return g.select("cell_id", r6("rf_prob_24h").alias("rf_prob_24h"), r6("rf_prob_7d").alias("rf_prob_7d"),
                    r6("lstm_pred_next24_count").alias("lstm_pred_next24_count"),
                    r6("lstm_prob_24h").alias("lstm_prob_24h"), r6("kde_score").alias("kde_score"),
                    r6("combined_prob_24h").alias("combined_prob_24h"),
                    r6("combined_prob_7d").alias("combined_prob_7d"))


def q_hotspot_top(spark, sf):
    g = forecast_df(spark, sf)["grid"]
    return G.top_k(g.select("cell_id", r6("combined_prob_24h").alias("combined_prob_24h")),
                   "combined_prob_24h", 10, "cell_id")


def q_permutation_importance(spark, sf):
    cells, counts = _cells_and_counts(spark, sf)
    history = T.history_features(counts)
    data = history.join(T.lead_labels(counts), ["cell_id", "time_bin"])
    info = M.train_forest(data, M.BASE_FEATURES, "label", 200, 42)
    if info["model"] is None:  # no cell has incidents on two days in a row, or all have: the 7-day label
        data = history.join(T.horizon_labels(counts).withColumnRenamed("label_7d", "label"), ["cell_id", "time_bin"])
        info = M.train_forest(data, M.BASE_FEATURES, "label", 200, 42)
    if info["model"] is None:
        return spark.createDataFrame([], "feature string, importance double, std double")
    return M.permutation_importance(info, data, "label", repeats=10, seed=0)


register("lag_sequences", q_lag_sequences, SQL_lag_sequences)
register("latest_features", q_latest_features, SQL_latest_features)
register("zscore_contrib", q_zscore_contrib, SQL_zscore_contrib)
register("drilldown", q_drilldown, SQL_drilldown)
register("incident_features", q_incident_features, SQL_incident_features)
register("hotspot_forecast", q_hotspot_forecast, None)
register("hotspot_top", q_hotspot_top, None)
register("permutation_importance", q_permutation_importance, None)
