"""Bad files, bad rows and skewed inputs that earlier versions got wrong."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigila.operators import features as FE
from vigila.operators import graph_build as B
from vigila.operators import links as L
from vigila.operators import models as M
from vigila.operators import normalize as N
from vigila.operators import timecell as T
from vigila.plans import jobs as J
from vigila.sources import readers as R
from vigila.streaming import alerts as A

INC = "fir_id string, date_time string, crime_type string, latitude double, longitude double"


def test_folder_reports_bad_files(spark, tmpdir_path):
    open(os.path.join(tmpdir_path, "a.csv"), "w").write("fir_id,date_time\nF1,2025-01-01 00:00:00\n")
    open(os.path.join(tmpdir_path, "b.parquet"), "w").write("no parquet")
    with pytest.raises(Exception):
        R.read_folder(spark, tmpdir_path)
    refused = []
    got = R.read_folder(spark, "file://" + tmpdir_path, refused)
    assert [label for label, _ in got["FIR"]] == ["a"] and [os.path.basename(p) for p, _ in refused] == ["b.parquet"]
    with pytest.raises(FileNotFoundError):
        R.read_folder(spark, os.path.join(tmpdir_path, "none"))


def test_paths_of_any_scheme(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.csv")
    open(p, "w").write("fir_id\nF1\n")
    assert R.read_any(spark, "file://" + p).count() == 1 and R.read_any(spark, None) is None
    with pytest.raises(FileNotFoundError):
        R.read_any(spark, p + "x")


def test_first_row_in_the_source_counts(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "i.csv")
    open(p, "w").write("fir_id,date_time,crime_type\nA,2025-03-01 00:00:00,late\nA,2025-01-01 00:00:00,early\n"
                       "B,bad,x\nB,2025-01-01 00:00:00,y\nC,2025-01-01 00:00:00,z\n")
    inc = N.normalize_incidents(R.read_incidents_csv(spark, p))
    assert {r.fir_id: r.crime_type for r in N.clean_incidents(inc).collect()} == {"A": "late", "C": "z"}
    assert {r.fir_id: r.crime_type for r in N.clean_incidents(inc, filter_first=True).collect()} == {
        "A": "late", "B": "y", "C": "z"}


def test_ids_of_sources_differ(spark):
    df = spark.createDataFrame([("2025-01-01 00:00:00", "x")] * 3 + [("2025-01-02 00:00:00", "x")], "date_time string, crime_type string")
    a = {r.fir_id for r in N.normalize_incidents(df, "one").collect()}
    b = {r.fir_id for r in N.normalize_incidents(df, "two").collect()}
    again = {r.fir_id for r in N.normalize_incidents(df.repartition(3), "one").collect()}
    assert len(a) == 4 and not a & b and a == again


def test_array_person_lists(spark):
    df = spark.createDataFrame([("F1", "2025-01-01 00:00:00", ["P1", " P2 ", ""])], "fir_id string, date_time string, accused array<string>")
    inc = N.normalize_incidents(df)
    assert sorted(r.p for r in N.explode_list(inc, "accused_list", "p").collect()) == ["P1", "P2"]
    _, e = B.case_graph(inc, "s")
    assert e.count() == 2


def test_graphs_of_few_inputs(spark, tmpdir_path):
    inc = N.normalize_incidents(spark.createDataFrame([("F1", "2025-01-01 00:00:00", "x", 28.5, 77.0)], INC))
    n, e = B.build_graph(inc, salt="s")
    assert n.count() == 1 and e.count() == 0
    loc = spark.createDataFrame([(28.5, 77.0, "a"), (28.5, 77.0, "b")], "latitude double, longitude double, name string")
    n, e = B.build_graph(locations=loc, salt="s")
    assert n.count() == 2 and e.count() == 0
    n, e = B.build_graph(inc, locations=loc, salt="s", proximity_m=50.0)
    assert e.count() == 2 and {r.dst for r in e.collect()} <= {r.id for r in n.collect()}
    p = os.path.join(tmpdir_path, "loc.csv")
    open(p, "w").write("latitude,longitude,name\n1.0,2.0,a\n")
    n, e = J.build_graph_job(spark, locations_path=p, salt="s")
    assert n.count() == 1 and e.count() == 0


def test_long_names_stay_apart(spark):
    long = "x" * 70
    df = spark.createDataFrame([("F1", "2025-01-01 00:00:00", f"{long}1;{long}2")], "fir_id string, date_time string, accused string")
    inc = N.normalize_incidents(df, "s")
    n, _ = B.case_graph(inc, "salt", scoped=True)
    assert n.where("label = 'Person'").count() == 2


def test_graphml_keeps_attributes(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "g.graphml")
    open(p, "w").write('<graphml><graph edgedefault="undirected"><node id="a"><data key="d0">Person</data></node>'
                       '<node id="b"/></graph></graphml>')
    n, e = R.read_graphml(spark, p)
    assert {r.id: r.attributes for r in n.collect()} == {"a": {"d0": "Person"}, "b": {}} and e.count() == 0


def test_median_of_heavy_values(spark):
    df = spark.createDataFrame([(float(i % 2),) for i in range(1000)] + [(None,), (float("nan"),)], "v double")
    assert FE.exact_median(df, "v") == 0.5
    vals = np.random.default_rng(0).normal(size=2001)
    assert FE.exact_median(spark.createDataFrame([(float(v),) for v in vals], "v double"), "v") == pytest.approx(np.median(vals))


def test_null_category_and_size_check(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    out, names = FE.one_hot(df, ["c"])
    assert [n[2] for n in names] == ["a", "nan"]
    assert sorted((r.cat_0, r.cat_1) for r in out.collect()) == [(0.0, 1.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        FE.one_hot(spark.range(50).selectExpr("cast(id as string) as c"), ["c"], max_columns=10)


def test_trailing_days_of_any_bin_size(spark):
    rows = [("c", f"2025-01-{d:02d} 00:00:00", 1) for d in range(1, 20, 2)]
    df = spark.createDataFrame(rows, "cell_id string, t string, crime_count long").select(
        "cell_id", F.col("t").cast("timestamp_ntz").alias("time_bin"), "crime_count")
    got = T.history_features(df, hours=48).orderBy("time_bin").collect()
    assert got[5].hist_3d == 2 and got[5].hist_7d == 4


def test_unknown_horizon_is_left_out(spark):
    df = spark.createDataFrame([("c", f"2025-01-{d:02d} 00:00:00", 1) for d in (1, 3, 9, 10)], "cell_id string, t string, crime_count long")
    lab = T.horizon_labels(df.select("cell_id", F.col("t").cast("timestamp_ntz").alias("time_bin"), "crime_count"))
    assert {r.time_bin.day: r.label_7d for r in lab.collect()} == {1: 1, 3: 1}


def test_permutation_ignores_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(n), int(x > 0), f"c{i}", "t") for i, (x, n) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "x double, n double, label int, cell_id string, time_bin string")
    info = M.train_forest(df, ["x", "n"], "label", 10, 1)
    got = [{r.feature: round(r.importance, 9) for r in M.permutation_importance(info, df.repartition(p), "label", 3, 0).collect()}
           for p in (1, 8, 50)]
    assert got[0] == got[1] == got[2] and got[0]["x"] > 0.2 > abs(got[0]["n"])


def test_shared_contacts_like_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(str(rng.integers(12)), str(rng.integers(3)), int(rng.integers(0, 40_000))) for _ in range(150)]
    calls = spark.createDataFrame(rows, "caller_id string, receiver_id string, s long").select(
        "caller_id", "receiver_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("start_time"))
    none = spark.createDataFrame([], "src string, dst string")
    got = L.shared_contact_pairs(calls, none, "s", 30).count()
    want = {tuple(sorted((a, b))) for a, r, s in rows for b, q, t in rows if a != b and r == q and abs(s - t) <= 1800}
    assert got == len(want)


def test_rising_count_and_faults(spark, tmpdir_path):
    table = os.path.join(tmpdir_path, "alerts")
    schema = "cell_id string, window_start timestamp, window_end timestamp, prob double, n_incidents long, msg string"
    start = spark.sql("select timestamp'2025-01-01 00:00:00' as t").first().t

    def batch(n):
        return spark.createDataFrame([("c", start, start, 0.9, n, "m")], schema)
    sink = A.alert_sink(table)
    for i, n in enumerate((1, 1, 2)):
        sink(batch(n), i)
    assert sorted(r.n_incidents for r in spark.read.parquet(table).collect()) == [1, 2]
    sink(batch(1).limit(0), 3)
    bad = os.path.join(tmpdir_path, "bad")
    os.mkdir(bad)
    open(os.path.join(bad, "part-0.parquet"), "w").write("no parquet")
    with pytest.raises(Exception):
        A.alert_sink(bad)(batch(1), 0)


def test_split_is_exact_in_every_class(spark):
    df = spark.range(1000).selectExpr("cast(id as string) as u", "cast(id as string) as v", "int(id % 10 = 0) as label")
    got = {(r.label, r.is_test): r["count"] for r in L.stratified_split(df, "label", 0.2, 7).groupBy("label", "is_test").count().collect()}
    assert got == {(0, True): 180, (0, False): 720, (1, True): 20, (1, False): 80}
    again = L.stratified_split(df.repartition(9), "label", 0.2, 7).where("is_test")
    assert {r.u for r in again.collect()} == {r.u for r in L.stratified_split(df, "label", 0.2, 7).where("is_test").collect()}


def test_large_polygon_and_points_without_place(spark):
    from vigila.operators import spatial as S

    def box(name, x0, y0, x1, y1):
        ring = [{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
        return (name, [ring])
    polys = spark.createDataFrame([box("big", 0.0, 0.0, 40.0, 40.0), box("small", 10.0, 10.0, 10.01, 10.01)],
                                  "region string, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(1, 10.005, 10.005), (2, 39.9, 0.1), (3, 41.0, 1.0), (4, None, 1.0)],
                                "id long, longitude double, latitude double")
    got = sorted((r.id, r.region or "") for r in S.points_in_polygons(pts, polys).collect())
    assert got == [(1, "big"), (1, "small"), (2, "big"), (3, ""), (4, "")]
    assert S.points_in_polygons(pts, polys.limit(0)).count() == 4


def test_edge_list(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "e.csv")
    open(p, "w").write("u,v\na,b\nb,c\n")
    assert {(r.src, r.dst) for r in R.read_edge_list(spark, p).collect()} == {("a", "b"), ("b", "c")}
