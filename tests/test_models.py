"""Forecast, features and the small numeric helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigila.operators import models as M
from vigila.operators import timecell as T
from vigila.operators import features as FE
from vigila.operators import aggregates as G
from vigila.plans.queries import clean_incidents_df
from conftest import SF_SMALL


def test_hotspot_forecast_shape_and_ranges(spark):
    inc = clean_incidents_df(spark, SF_SMALL)
    res = M.hotspot_forecast(inc, 500.0, 7, n_trees=20)
    g = res["grid"]
    n = g.count()
    assert n == g.select("cell_id").distinct().count() and n > 0
    for c in ["rf_prob_24h", "rf_prob_7d", "lstm_prob_24h", "kde_score", "combined_prob_24h", "combined_prob_7d"]:
        lo, hi = g.agg(F.min(c), F.max(c)).first()
        assert 0.0 <= lo <= hi <= 1.0, c
    assert g.agg(F.max("combined_prob_24h")).first()[0] > 0.99


def test_prefix_sums_match_cumsum(spark):
    rnd = np.random.default_rng(0)
    vals = rnd.integers(0, 5, 2000)
    df = spark.createDataFrame([(float(i), int(v)) for i, v in enumerate(vals)], "k double, v long")
    got = {r.k: r.cum_v for r in G.prefix_sums(df, "k", ["v"], buckets=16).collect()}
    cs = np.cumsum(vals)
    assert all(got[float(i)] == cs[i] for i in range(len(vals)))
    ex = {r.k: r.cum_v for r in G.prefix_sums(df, "k", ["v"], descending=True, inclusive=False,
                                                buckets=16).collect()}
    rev = np.concatenate([[0], np.cumsum(vals[::-1])[:-1]])[::-1]
    assert all(ex[float(i)] == rev[i] for i in range(len(vals)))


def test_minmax_sequences(spark):
    counts = spark.createDataFrame(
        [("c1", f"2024-01-{d:02d} 00:00:00", v) for d, v in zip(range(1, 11), [1, 0, 3, 0, 0, 2, 0, 0, 0, 4])],
        "cell_id string, time_bin string, crime_count long").withColumn(
        "time_bin", F.col("time_bin").cast("timestamp_ntz")).where("crime_count > 0")
    seqs = T.lag_sequences(counts, 3)
    sc = T.minmax_sequences(seqs, 3)
    rows = sc.collect()
    assert rows and all(0.0 <= r[c] <= 1.0 for r in rows for c in ["lag_1", "lag_2", "lag_3", "target"])


def test_one_hot_unknown_and_scale(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 5.0)], "crime_type string, x double")
    out, names = FE.one_hot(df, ["crime_type", "victim_gender"])
    assert [n for n, _, _ in names] == ["cat_0", "cat_1", "cat_2"]
    assert [(c, v) for _, c, v in names] == [("crime_type", "a"), ("crime_type", "b"), ("victim_gender", "unknown")]
    sc = FE.standard_scale(df, ["x"]).collect()
    assert [round(r.x, 6) for r in sc] == [round(v, 6) for v in (np.array([1, 3, 5]) - 3) / np.std([1, 3, 5])]


def test_zscore_and_drilldown(spark):
    cells = spark.createDataFrame([("c1", 1.0, 10.0), ("c2", 2.0, 10.0), ("c3", 9.0, 10.0)],
                                  "cell_id string, hist_1d double, hist_3d double")
    z = FE.zscore_contributions(cells, ["hist_1d", "hist_3d"], 1).collect()
    top = {r.cell_id: r.feature for r in z}
    assert top == {"c1": "hist_1d", "c2": "hist_1d", "c3": "hist_1d"}
    d = FE.drilldown(cells)
    assert d.count() == 6 and set(d.columns) == {"cell_id", "feature", "value"}


def test_permutation_importance_ranks_informative_feature(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(600):
        y = int(rnd.random() < 0.5)
        rows.append((f"c{i}", "2024-01-01 00:00:00", float(y) + rnd.normal(0, 0.1), float(rnd.normal()), y))
    df = spark.createDataFrame(rows, "cell_id string, time_bin string, good double, noise double, label int")
    info = M.train_forest(df, ["good", "noise"], "label", 20, 42)
    imp = {r.feature: r.importance for r in M.permutation_importance(info, df, "label", repeats=3).collect()}
    assert imp["good"] > 0.2 and imp["good"] > imp["noise"]
