"""Readers, writers and end-to-end jobs on small hand-made files."""

import glob
import json
import os

from pyspark.sql import functions as F

from vigila.sources import readers as R
from vigila.sources import sinks as W
from vigila.operators import normalize as N
from vigila.plans import jobs as J

INCIDENTS = """fir_id,date_time,crime_type,latitude,longitude,accused,victim,details
F1,2025-02-01 10:00:00, Theft ,28.7010,77.1010,P1;P2,V1,bag taken
F2,2025-02-01 11:30:00,Robbery,28.7020,77.1020,P2,V2,chain
F2,2025-02-02 09:00:00,robbery,28.7020,77.1020,P3,V3,duplicate id
F3,not a date,Assault,28.7030,77.1030,P4,V4,bad time
F4,2025-02-03 20:00:00,Burglary,,77.1040,P5,V5,no latitude
F5,2025-02-04 07:00:00,Theft,19.0500,72.8500,P1,V6,far away
"""

CALLS = """caller_id,callee_id,timestamp,cell_tower_id,latitude,longitude
P1,P2,2025-02-01 10:20:00,T01,28.7011,77.1011
P2,P3,2025-02-01 11:00:00,T02,28.7021,77.1019
P3,P1,2025-02-01 13:00:00,T03,28.7500,77.1500
P4,P1,2025-02-03 20:30:00,T04,28.7040,77.1040
"""

DEMOGRAPHICS = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"region": "North", "population": 1000, "density": 50},
     "geometry": {"type": "Polygon", "coordinates": [[[77.0, 28.6], [77.2, 28.6], [77.2, 28.8], [77.0, 28.8], [77.0, 28.6]]]}},
    {"type": "Feature", "properties": {"region": "West", "population": 2000, "density": 70},
     "geometry": {"type": "Polygon", "coordinates": [[[72.8, 19.0], [72.9, 19.0], [72.9, 19.1], [72.8, 19.1], [72.8, 19.0]]]}}]}

GRAPHML = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <graph id="G" edgedefault="undirected">
    <node id="a"/><node id="b"/><node id="c"/>
    <edge source="a" target="b"/>
    <edge source="b" target="c"/>
  </graph>
</graphml>
"""


def files(d):
    p = {"inc": os.path.join(d, "incidents.csv"), "cdr": os.path.join(d, "calls.csv"),
         "dem": os.path.join(d, "demo.geojson"), "gml": os.path.join(d, "g.graphml")}
    open(p["inc"], "w").write(INCIDENTS)
    open(p["cdr"], "w").write(CALLS)
    json.dump(DEMOGRAPHICS, open(p["dem"], "w"))
    open(p["gml"], "w").write(GRAPHML)
    return p


def test_read_normalise_clean(spark, tmpdir_path):
    p = files(tmpdir_path)
    inc = N.clean_incidents(N.normalize_incidents(R.read_incidents_csv(spark, p["inc"])))
    rows = {r.fir_id: r for r in inc.collect()}
    assert set(rows) == {"F1", "F2", "F4", "F5"}          # F3 bad time dropped, F2 deduplicated
    assert rows["F1"].crime_type == "theft"
    assert rows["F2"].accused_list == "P2"                 # the first F2 (earliest) kept
    assert rows["F4"].point is None and rows["F4"].latitude is None
    cal = N.clean_calls(N.normalize_calls(R.read_calls_csv(spark, p["cdr"])))
    c = cal.orderBy("start_time").first()
    assert c.receiver_id == "P2" and str(c.start_time) == "2025-02-01 10:20:00"
    assert dict(zip(cal.columns, [f.dataType.simpleString() for f in cal.schema.fields]))["cell_tower_id"] == "string"


def test_geojson_graphml_wkt(spark, tmpdir_path):
    p = files(tmpdir_path)
    g = R.read_geojson(spark, p["dem"])
    g = R.geojson_properties(g, {"region": "string", "population": "long"})
    rows = {r.region: r for r in g.collect()}
    assert rows["North"].population == 1000 and len(rows["North"].rings[0]) == 5
    nodes, edges = R.read_graphml(spark, p["gml"])
    assert nodes.count() == 3 and edges.count() == 2
    wkt = os.path.join(tmpdir_path, "w.csv")
    open(wkt, "w").write('name,geom\nz,"POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"\np,"POINT (1.5 2.5)"\n')
    w = {r.name: r for r in R.read_wkt_csv(spark, wkt, "geom").collect()}
    assert w["z"].rings[0][2].x == 2.0 and w["p"].lon == 1.5 and w["p"].lat == 2.5


def test_classify_and_folder(spark, tmpdir_path):
    assert R.classify_columns(["FIR_ID", "x"]) == "FIR"
    assert R.classify_columns(["caller_id"]) == "CDR"
    assert R.classify_columns(["foo"]) == "FIR"
    files(tmpdir_path)
    got = R.read_folder(spark, tmpdir_path)
    assert [lbl for lbl, _ in got["CDR"]] == ["calls"]
    assert "incidents" in [lbl for lbl, _ in got["FIR"]]


def test_writers_roundtrip(spark, tmpdir_path):
    p = files(tmpdir_path)
    nodes, edges = R.read_graphml(spark, p["gml"])
    nodes = nodes.withColumn("label", F.lit("Person"))
    edges = edges.withColumn("relation", F.lit("CALLED"))
    out = os.path.join(tmpdir_path, "out.graphml")
    W.write_graphml(nodes, edges, out)
    doc = "".join(open(f).read() for f in sorted(glob.glob(os.path.join(out, "part-*"))))
    one = os.path.join(tmpdir_path, "one.graphml")
    open(one, "w").write(doc)
    n2, e2 = R.read_graphml(spark, one)
    assert sorted(r.id for r in n2.collect()) == ["a", "b", "c"] and e2.count() == 2
    inc = N.normalize_incidents(R.read_incidents_csv(spark, p["inc"]))
    gj = os.path.join(tmpdir_path, "inc.geojsonl")
    W.write_geojson_seq(inc.drop("point"), gj)
    back = R.read_geojson_seq(spark, gj)
    assert back.count() == 6 and back.where(F.col("lon").isNotNull()).count() == 5
    csvp = os.path.join(tmpdir_path, "csv")
    W.write_csv(inc, csvp)
    assert "point" not in spark.read.option("header", True).csv(csvp).columns


def test_upsert_and_unique(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    u = {r.k: r.v for r in W.upsert(old, new, "k").collect()}
    assert u == {"a": 1, "b": 3, "c": 4}
    assert W.assert_unique(W.append(old, new), "k").count() == 1


def test_preprocess_job(spark, tmpdir_path):
    p = files(tmpdir_path)
    out = os.path.join(tmpdir_path, "processed")
    J.run_preprocess(spark, p["inc"], p["cdr"], p["dem"], out, salt="test-salt")
    df = spark.read.option("header", True).csv(out)
    rows = {r.fir_id: r for r in df.collect()}
    assert set(rows) == {"F1", "F2", "F4", "F5"}
    assert rows["F1"].region == "North" and rows["F5"].region == "West"
    assert rows["F1"].start_time_count == "2"      # 10:20 and 11:00 (exactly 60 min, inclusive)
    assert {"cat_0", "cat_1", "hour", "dayofweek"} <= set(df.columns)
    assert "P1" not in " ".join(str(v) for r in df.collect() for v in r if v and "caller" in str(v))


def test_graph_job_and_cross_source(spark, tmpdir_path):
    p = files(tmpdir_path)
    nodes, edges = J.build_graph_job(spark, p["inc"], p["cdr"], salt="s", out_graphml=os.path.join(tmpdir_path, "g"))
    labels = {r.label: r.n for r in nodes.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert labels["Case"] == 5 and labels["Phone"] == 4 and labels["Person"] >= 5
    assert all(not r.id.endswith("P1") for r in nodes.collect())      # people and phones are hashed
    res = J.cross_source(spark, tmpdir_path, salt="s", proximity_m=200.0)
    top = res["top"].collect()
    assert 0 < len(top) <= 15
    rel = {r.relation for r in res["edges"].collect()}
    assert {"CO_OFFEND", "CALLED", "NEAR_TOWER"} <= rel
