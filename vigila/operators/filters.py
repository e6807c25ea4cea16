"""Row filters (F1-F8).  All are plain predicates, so Catalyst pushes the
column comparisons into the Parquet scan where the column is stored."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import bbox_filter


def category_filter(df: DataFrame, values, col: str = "crime_type") -> DataFrame:
    """membership; an empty or missing selection keeps every row."""
    return df.where(F.col(col).isin(list(values))) if values else df


def default_categories(df: DataFrame, col: str = "crime_type", n: int = 5) -> DataFrame:
    """F1 default selection: the first ``n`` distinct values alphabetically."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(n)


def date_range_filter(df: DataFrame, start, end, col: str = "date_time",
                      skip_if_all_null: bool = True) -> DataFrame:
    """half-open ``[start, end + 1 day)`` on a date range.  As in the
    source tool, the filter is skipped when every time is null; that test
    is an ``EXISTS`` scalar subquery, not a driver round trip."""
    s = F.lit(_as_ts(start)).cast("timestamp_ntz")
    e = (F.lit(_as_ts(end)).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    cond = (F.col(col) >= s) & (F.col(col) < e)
    if not skip_if_all_null:
        return df.where(cond)
    any_time = df.where(F.col(col).isNotNull()).select(F.lit(1)).limit(1).exists()
    return df.where(~any_time | cond)


def trailing_from_max(df: DataFrame, hours: float = 72.0, col: str = "date_time") -> DataFrame:
    """rows at or after (max(time) - hours)."""
    tmax = df.agg(F.max(col)).scalar()
    return df.where(F.col(col) >= tmax - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                            F.lit(float(hours) * 3600)))


def trailing_from_now(df: DataFrame, minutes: float = 60.0, col: str = "date_time",
                      now=None) -> DataFrame:
    """rows at or after (now - minutes); ``now`` may be given for tests."""
    ref = F.lit(_as_ts(now)).cast("timestamp_ntz") if now is not None else \
        F.current_timestamp().cast("timestamp_ntz")
    return df.where(F.col(col) >= ref - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                           F.lit(float(minutes) * 60)))


def prob_threshold(df: DataFrame, p: float = 0.7, col: str = "combined_prob_24h") -> DataFrame:
    """probability at or above the threshold."""
    return df.where(F.col(col) >= p)


def latest_bin(df: DataFrame, col: str = "time_bin") -> DataFrame:
    """rows of the latest time bin (scalar subquery, no join)."""
    return df.where(F.col(col) == df.agg(F.max(col)).scalar())


def min_degree_subgraph(nodes: DataFrame, edges: DataFrame, degrees: DataFrame,
                        min_degree: int) -> tuple[DataFrame, DataFrame]:
    """induced subgraph on nodes whose degree in the full graph is at
    least ``min_degree``; edges kept when both ends survive (semi joins)."""
    keep = degrees.where(F.col("degree") >= min_degree).select("id")
    n = nodes.join(keep, "id", "left_semi")
    e = (edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi")
              .join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return n, e


def filter_incidents(df: DataFrame, categories=None, date_range=None, bbox=None) -> DataFrame:
    """F8: category + date range + bounding box, for incidents."""
    df = category_filter(df, categories)
    if date_range:
        df = date_range_filter(df, date_range[0], date_range[1], "date_time")
    if bbox:
        df = bbox_filter(df, bbox, "longitude", "latitude")
    return df


def filter_calls(df: DataFrame, date_range=None, bbox=None) -> DataFrame:
    """F8: date range + bounding box, for calls."""
    if date_range:
        df = date_range_filter(df, date_range[0], date_range[1], "start_time")
    if bbox:
        df = bbox_filter(df, bbox, "tower_lon", "tower_lat")
    return df


def _as_ts(v):
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, _dt.date):
        return _dt.datetime(v.year, v.month, v.day)
    return _dt.datetime.fromisoformat(str(v))
