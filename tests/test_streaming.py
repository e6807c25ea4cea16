"""Alert stream: file source, availableNow, duplicates and restart."""

import os

from pyspark.sql import functions as F

from vigila.streaming import start_alerts, alert_history
from vigila.operators import spatial as S

COLS = ("fir_id", "date_time", "lat", "lon")


def _write(folder, name, rows):
    with open(os.path.join(folder, name), "w") as f:
        f.write("fir_id,date_time,lat,lon\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_alert_stream_restart_and_dedupe(spark, tmpdir_path):
    base = tmpdir_path
    inbox = os.path.join(base, "inbox"); os.makedirs(inbox)
    # a forecast grid over a small area, every cell hot except one
    pts = spark.createDataFrame([(28.50, 77.00), (28.52, 77.03)], "latitude double, longitude double")
    spec = S.grid_spec(S.project(pts), 500.0)
    cells = S.grid_cells(spec).withColumn(
        "combined_prob_24h", F.when(F.col("cell_id") == "cell_0_0", 0.1).otherwise(0.9))
    params = spec.select("minx", "miny", "size").first().asDict()
    # 28.5105N 77.0105E sits in a hot cell; 28.5001N 77.0001E in cell_0_0 (cold)
    _write(inbox, "a.csv", [("f1", "2024-01-01 10:00:00", "28.5105", "77.0105"),
                            ("f2", "2024-01-01 10:10:00", "28.5105", "77.0105"),
                            ("f3", "2024-01-01 10:12:00", "28.5001", "77.0001")])
    table = os.path.join(base, "alerts")
    ckpt = os.path.join(base, "ckpt")
    q = start_alerts(spark, inbox, cells, params, table, ckpt, columns=COLS)
    q.awaitTermination(120)
    a1 = spark.read.parquet(table)
    assert a1.where(F.col("cell_id") == "cell_0_0").count() == 0
    n1 = a1.count()
    assert n1 > 0
    assert a1.groupBy("cell_id", "window_start").count().where("count > 1").count() == 0
    # new file: more incidents in the same windows plus a later one; restart from checkpoint
    _write(inbox, "b.csv", [("f4", "2024-01-01 10:20:00", "28.5105", "77.0105"),
                            ("f5", "2024-01-01 13:00:00", "28.5105", "77.0105")])
    q = start_alerts(spark, inbox, cells, params, table, ckpt, columns=COLS)
    q.awaitTermination(120)
    a2 = spark.read.parquet(table)
    assert a2.groupBy("cell_id", "window_start", "n_incidents").count().where("count > 1").count() == 0
    assert a2.count() > n1
    assert a2.where(F.col("window_start") >= F.lit("2024-01-01 12:00:00").cast("timestamp")).count() > 0
    assert alert_history(spark, table, 20).count() <= 20


def test_late_rows_are_dropped(spark, tmpdir_path):
    base = tmpdir_path
    inbox = os.path.join(base, "inbox"); os.makedirs(inbox)
    pts = spark.createDataFrame([(28.50, 77.00), (28.52, 77.03)], "latitude double, longitude double")
    spec = S.grid_spec(S.project(pts), 500.0)
    cells = S.grid_cells(spec).withColumn("combined_prob_24h", F.lit(0.9))
    params = spec.select("minx", "miny", "size").first().asDict()
    table, ckpt = os.path.join(base, "alerts"), os.path.join(base, "ckpt")
    _write(inbox, "a.csv", [("f1", "2024-01-01 15:00:00", "28.5105", "77.0105")])
    start_alerts(spark, inbox, cells, params, table, ckpt, columns=COLS).awaitTermination(120)
    # a second batch advances the watermark to 14:00; a row at 10:00 is then late
    _write(inbox, "b.csv", [("f2", "2024-01-01 15:01:00", "28.5105", "77.0105")])
    start_alerts(spark, inbox, cells, params, table, ckpt, columns=COLS).awaitTermination(120)
    _write(inbox, "c.csv", [("f3", "2024-01-01 10:00:00", "28.5105", "77.0105")])
    start_alerts(spark, inbox, cells, params, table, ckpt, columns=COLS).awaitTermination(120)
    a = spark.read.parquet(table)
    assert a.where(F.col("window_start") < F.lit("2024-01-01 12:00:00").cast("timestamp")).count() == 0


def test_polls_are_logged_over_a_restart(spark, tmpdir_path):
    import time
    from vigila.streaming import last_poll, polls
    base = tmpdir_path
    inbox = os.path.join(base, "inbox"); os.makedirs(inbox)
    pts = spark.createDataFrame([(28.50, 77.00), (28.52, 77.03)], "latitude double, longitude double")
    spec = S.grid_spec(S.project(pts), 500.0)
    cells = S.grid_cells(spec).withColumn("combined_prob_24h", F.lit(0.9))
    params = spec.select("minx", "miny", "size").first().asDict()
    table, ckpt, log = (os.path.join(base, x) for x in ("alerts", "ckpt", "polls"))
    for i, rows in enumerate((2, 1)):
        _write(inbox, f"{i}.csv", [(f"f{i}{j}", "2024-01-01 15:00:00", "28.5105", "77.0105") for j in range(rows)])
        q = start_alerts(spark, inbox, cells, params, table, ckpt, columns=COLS, poll_path=log, name="watch")
        q.awaitTermination(120)
        want = 3 if i else 2
        for _ in range(60):  # events come after the batch
            if os.path.exists(log) and (polls(spark, log).agg(F.sum("rows")).first()[0] or 0) >= want:
                break
            time.sleep(1)
        spark.streams.removeListener(q.poll_log)
    got = last_poll(spark, log).collect()
    assert [(r["query"], r["batches"], r["rows"]) for r in got] == [("watch", 2, 3)]
    times = polls(spark, log)
    assert got[0]["last_poll"] == times.agg(F.max("polled_at")).first()[0] >= got[0]["last_rows_at"]
    assert times.select("run_id").distinct().count() == 2
