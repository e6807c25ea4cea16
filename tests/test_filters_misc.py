"""Filters, exported graphs, schema checks and small helpers."""

import os

import pytest
from pyspark.sql import functions as F

from vigila.operators import filters as FL
from vigila.operators import normalize as N
from vigila.operators import spatial as S
from vigila.operators import timecell as T
from vigila.operators import graph_algo as GA
from vigila.sources import readers as R


def test_date_range_skips_when_all_null(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "fir_id string, date_time timestamp_ntz")
    assert FL.date_range_filter(df, "2024-01-01", "2024-01-02").count() == 2
    df2 = spark.createDataFrame([("a", "2024-01-02 23:59:59"), ("b", "2024-01-03 00:00:00")],
                                "fir_id string, date_time string").withColumn(
        "date_time", F.col("date_time").cast("timestamp_ntz"))
    assert [r.fir_id for r in FL.date_range_filter(df2, "2024-01-01", "2024-01-02").collect()] == ["a"]


def test_trailing_windows(spark):
    df = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 11:30:00"),
                                ("c", "2024-01-04 11:30:00")], "fir_id string, date_time string") \
        .withColumn("date_time", F.col("date_time").cast("timestamp_ntz"))
    assert {r.fir_id for r in FL.trailing_from_max(df, 72.0).collect()} == {"b", "c"}
    assert {r.fir_id for r in FL.trailing_from_now(df, 60.0, now="2024-01-01 12:00:00").collect()} == {"b", "c"}


def test_bbox_filter_strict_and_bad_text(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (None, 1.0)], "longitude double, latitude double")
    assert FL.category_filter(df, [], "longitude").count() == 3
    assert S.bbox_filter(df, "0,0,2,2").count() == 1
    with pytest.raises(ValueError):
        S.bbox_filter(df, "0,0,two,2")


def test_lead_labels_exact_lag(spark):
    c = spark.createDataFrame([("x", "2024-01-01", 1), ("x", "2024-01-02", 2), ("x", "2024-01-04", 1)],
                              "cell_id string, time_bin string, crime_count long") \
        .withColumn("time_bin", F.col("time_bin").cast("timestamp_ntz"))
    lab = {str(r.time_bin)[:10]: r.label for r in T.lead_labels(c).collect()}
    assert lab == {"2024-01-01": 1, "2024-01-02": 0, "2024-01-04": 0}
    h = {str(r.time_bin)[:10]: r.hist_1d for r in T.history_features(c).collect()}
    assert h == {"2024-01-01": 1, "2024-01-02": 3, "2024-01-04": 1}


def test_exported_graph_and_subgraph(spark, tmpdir_path):
    nodes = spark.createDataFrame([("1", ["Person", "X"]), ("2", []), ("3", ["Case"])], "id string, labels array<string>")
    edges = spark.createDataFrame([("2", "1", "KNOWS"), ("1", "2", "KNOWS"), ("1", "3", "IN")],
                                  "a string, b string, rel string")
    npath, epath = os.path.join(tmpdir_path, "n"), os.path.join(tmpdir_path, "e")
    nodes.write.parquet(npath)
    edges.write.parquet(epath)
    n, e = R.read_exported_graph(spark, npath, epath)
    assert {r.id: r.label for r in n.collect()} == {"1": "Person", "2": "Entity", "3": "Case"}
    assert sorted((r.src, r.dst) for r in e.collect()) == [("1", "2"), ("1", "3")]
    sn, se = FL.min_degree_subgraph(n, e, GA.degree(n, e), 2)
    assert [r.id for r in sn.collect()] == ["1"] and se.count() == 0


def test_schema_diff_and_quality(spark):
    df = spark.createDataFrame([("a", None, 1.0)], "fir_id string, date_time string, latitude double")
    d = {r.column: r.present for r in N.schema_diff(df, {"fir_id": "string", "longitude": "double"}).collect()}
    assert d == {"fir_id": True, "longitude": False}
    inc = N.normalize_incidents(df)
    assert inc.where(F.col("point").isNull()).count() == 1
