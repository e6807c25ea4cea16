"""Models and the hotspot forecast.

Training uses ``pyspark.ml`` estimators on DataFrames; scoring is
``transform``.  Per-cell features at the forecast time are computed for
every grid cell by aggregates over the (cell, bin) count table, so cells
without recent activity are scored on zero history rather than dropped.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as ST

from . import spatial as S
from . import timecell as T
from .links import apply_scaler, fit_scaler, stratified_split, auc_ap
from ..functions.timefn import day_index

HIST_COLS = [f"hist_{w}d" for w in T.HISTORY_WINDOWS]
BASE_FEATURES = HIST_COLS + ["hour", "weekday"]
# Ensemble weights of forest, sequence model and density.
W_FOREST, W_SEQUENCE, W_DENSITY = 0.5, 0.3, 0.2


def train_forest(df: DataFrame, feature_cols: list[str], label: str = "label", n_trees: int = 200,
                 seed: int = 42, test_size: float = 0.2, keys=("cell_id", "time_bin")) -> dict:
    """M6 + M2 + M7 + M9: stratified split, scaler fit on the training
    rows, random forest, test ROC AUC (None with one class).  A training
    set with a single class gives a constant-probability model."""
    from ..session import cut_lineage
    # the labelled features are read by the scaler, the class check, the
    # fit and the test scoring: materialise them once
    data = cut_lineage(stratified_split(df.withColumn(label, F.col(label).cast("int")), label, test_size, seed,
                                        keys=[F.col(k).cast("string") for k in keys]))
    train = data.where(~F.col("is_test"))
    scaler = fit_scaler(train, feature_cols)
    classes = [r[0] for r in train.select(label).distinct().collect()]
    if len(classes) < 2:
        const = float(classes[0]) if classes else 0.0
        return {"model": None, "constant": const, "scaler": scaler, "auc": None, "features": feature_cols}
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=n_trees, seed=seed)
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit_rows = apply_scaler(train, scaler).withColumn(label, F.col(label).cast("double")) \
        .select("features", label).repartition(n_parts)
    model = rf.fit(fit_rows)
    test = data.where(F.col("is_test"))
    scored = model.transform(apply_scaler(test, scaler)).withColumn("score", vector_to_array("probability")[1])
    auc = auc_ap(scored, "score", label).first()["auc"]
    return {"model": model, "constant": None, "scaler": scaler, "auc": auc, "features": feature_cols}


def score_forest(info: dict, df: DataFrame, out: str) -> DataFrame:
    """Probability of class 1 from :func:`train_forest`'s bundle."""
    if info["model"] is None:
        return df.withColumn(out, F.lit(info["constant"]))
    s = info["model"].transform(apply_scaler(df, info["scaler"]))
    return s.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction",
                                                                     "probability", "prediction")


def features_at(counts: DataFrame, cells: DataFrame, at, windows=T.HISTORY_WINDOWS) -> DataFrame:
    """History features of every cell at bin ``at`` (a column/scalar):
    trailing sums over [at - w days, at], hour and weekday of ``at``."""
    d_at = day_index(at)
    c = counts.withColumn("_age", (d_at - day_index("time_bin")).cast("long"))
    aggs = [F.sum(F.when((F.col("_age") >= 0) & (F.col("_age") <= w), F.col("crime_count")).otherwise(0))
            .alias(f"hist_{w}d") for w in windows]
    hist = c.where((F.col("_age") >= 0) & (F.col("_age") <= max(windows))).groupBy("cell_id").agg(*aggs)
    out = cells.select("cell_id").join(hist, "cell_id", "left").na.fill(0, [f"hist_{w}d" for w in windows])
    return out.withColumns({"hour": F.hour(at), "weekday": F.weekday(at)})


def sequence_forecast(counts: DataFrame, cells: DataFrame, seq_len: int = 7) -> DataFrame:
    """M11 (re-aimed): a pooled Poisson regression of the next bin's count
    on the previous ``seq_len`` bins, trained on the sparse lag table
    (T5) plus one row standing for all the all-zero windows, weighted by
    their number.  Returns per cell the forecast count for the bin after
    the last observed one and ``lstm_prob_24h`` = P(count >= 1) = 1 - e^-mu."""
    lags = [f"lag_{k}" for k in range(1, seq_len + 1)]
    from ..session import cut_lineage
    seqs = cut_lineage(T.lag_sequences(counts, seq_len))
    bins = T.bin_index(counts)
    nb = bins.agg(F.max("bin_no")).first()[0]  # number of observed bins - 1 (bounded scalar)
    if nb is None:
        return cells.select("cell_id", F.lit(0.0).alias("lstm_pred_next24_count"),
                            F.lit(0.0).alias("lstm_prob_24h"))
    n_cells = cells.count()
    spark = counts.sparkSession
    n_windows = nb - seq_len + 1
    pos_rows = seqs.count()
    zero_w = max(0, n_cells * max(n_windows, 0) - pos_rows)
    train = seqs.select(*lags, F.col("target").cast("double").alias("label"), F.lit(1.0).alias("weight"))
    if zero_w > 0:
        train = train.unionByName(spark.range(1).select(*[F.lit(0).cast("long").alias(l) for l in lags],
                                                        F.lit(0.0).alias("label"),
                                                        F.lit(float(zero_w)).alias("weight")))
    from pyspark.ml.feature import VectorAssembler
    asm = VectorAssembler(inputCols=lags, outputCol="features")
    has_pos = train.where(F.col("label") > 0).limit(1).count() > 0
    # forecast rows: lags relative to the bin after the last one
    c = counts.join(bins, "time_bin")
    sends = c.withColumn("_k", (F.lit(nb + 1) - F.col("bin_no")).cast("int")).where(
        (F.col("_k") >= 1) & (F.col("_k") <= seq_len))
    last = sends.groupBy("cell_id").pivot("_k", list(range(1, seq_len + 1))).agg(F.sum("crime_count"))
    last = last.select("cell_id", *[F.col(str(k)).alias(f"lag_{k}") for k in range(1, seq_len + 1)])
    fc = cells.select("cell_id").join(last, "cell_id", "left").na.fill(0, lags)
    if nb + 1 <= seq_len or not has_pos:
        return fc.select("cell_id", F.lit(0.0).alias("lstm_pred_next24_count"),
                         F.lit(0.0).alias("lstm_prob_24h"))
    glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="features", labelCol="label",
                                      weightCol="weight", maxIter=50, regParam=1e-6)
    model = glm.fit(asm.transform(train))
    pred = model.transform(asm.transform(fc))
    return pred.select("cell_id", F.col("prediction").alias("lstm_pred_next24_count"),
                       (F.lit(1.0) - F.exp(-F.col("prediction"))).alias("lstm_prob_24h"))


def hotspot_forecast(incidents: DataFrame, cell_size: float = 500.0, seq_len: int = 7,
                     n_trees: int = 200, seed: int = 42, bandwidth: float = 1000.0,
                     kde_hours: float = 72.0, horizon_7d: bool = True,
                     demographics: DataFrame | None = None) -> dict:
    """Grid, counts per (cell, day), history features and labels,
    forest on the labelled history, scores for every cell at the latest
    bin, sequence forecast, kernel density, and the min-max scaled ensemble
    0.5 forest + 0.3 sequence + 0.2 density.  ``horizon_7d`` trains a second
    forest on the true 7-day label (else the 24-hour score is copied).
    Returns ``{"grid": DataFrame, "rf_info": dict, "rf7_info": dict|None}``."""
    inc = incidents.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    pts = S.project(inc).where(F.col("x").isNotNull())
    spec = S.grid_spec(pts, cell_size)
    cells = S.grid_cells(spec).persist()
    counts = T.timecell_counts(S.assign_cells(pts, spec)).persist()
    feat = T.history_features(counts)
    extra_cols: list[str] = []
    if demographics is not None:
        demo = _cell_demographics(cells, demographics)
        extra_cols = [c for c in demo.columns if c != "cell_id"]
        feat = feat.join(demo, "cell_id", "left").na.fill(0.0, extra_cols)
    lab = T.lead_labels(counts)
    data = feat.join(lab, ["cell_id", "time_bin"], "left").na.fill(0, ["label"])
    fcols = BASE_FEATURES + extra_cols
    rf_info = train_forest(data, fcols, "label", n_trees, seed)
    latest = counts.agg(F.max("time_bin")).scalar()
    now = features_at(counts, cells, latest)
    if demographics is not None:
        now = now.join(demo, "cell_id", "left").na.fill(0.0, extra_cols)
    grid = score_forest(rf_info, now, "rf_prob_24h")
    rf7_info = None
    if horizon_7d:
        lab7 = T.horizon_labels(counts).withColumnRenamed("label_7d", "label")
        rf7_info = train_forest(feat.join(lab7, ["cell_id", "time_bin"]), fcols, "label", n_trees, seed)
        grid = score_forest(rf7_info, grid, "rf_prob_7d")
    else:
        grid = grid.withColumn("rf_prob_7d", F.col("rf_prob_24h"))
    seq = sequence_forecast(counts, cells, seq_len)
    kde = S.kde_cells(inc, cells, bandwidth, kde_hours)
    grid = (cells.join(grid, "cell_id").join(seq, "cell_id", "left").join(kde.select("cell_id", "kde_score"),
                                                                            "cell_id", "left")
            .na.fill(0.0, ["lstm_pred_next24_count", "lstm_prob_24h", "kde_score"]))
    from ..session import cut_lineage
    grid = cut_lineage(grid)  # scored once; the min-max statistics read it again
    cells.unpersist()
    counts.unpersist()
    grid = grid.withColumns({
        "_c24": F.lit(W_FOREST) * F.col("rf_prob_24h") + F.lit(W_SEQUENCE) * F.col("lstm_prob_24h")
        + F.lit(W_DENSITY) * F.col("kde_score"),
        "_c7": F.lit(W_FOREST) * F.col("rf_prob_7d") + F.lit(W_SEQUENCE) * F.col("lstm_prob_24h")
        + F.lit(W_DENSITY) * F.col("kde_score")})
    grid = S.minmax_scale(grid, "_c24", "combined_prob_24h")
    grid = S.minmax_scale(grid, "_c7", "combined_prob_7d").drop("_c24", "_c7")
    return {"grid": grid, "rf_info": rf_info, "rf7_info": rf7_info}


def _cell_demographics(cells: DataFrame, demographics: DataFrame) -> DataFrame:
    """Numeric attributes of the polygon containing each cell centroid."""
    num = [f.name for f in demographics.schema.fields
           if f.name != "rings" and f.dataType.typeName() in ("long", "integer", "double", "float")]
    j = S.points_in_polygons(cells.select("cell_id", "lon", "lat"), demographics, lon="lon", lat="lat")
    return j.groupBy("cell_id").agg(*[F.max(F.col(c).cast("double")).alias(c) for c in num])


def permutation_importance(info: dict, df: DataFrame, label: str = "label", repeats: int = 10,
                           seed: int = 0) -> DataFrame:
    """Mean drop in accuracy when one feature's values are permuted.

    Rows are numbered once in the order of a seeded hash of their values, so
    the result doesn't depend on partitions (equal rows may swap numbers without
    any effect).  Each (feature, repeat) has a permutation ``a * number + b mod
    n`` with ``a`` prime to n, and a join on the number brings the value.  One
    ``transform`` scores all copies.  Returns ``feature, importance, std``
    (population std over the repeats)."""
    import math
    import random

    from ..session import cut_lineage
    cols = list(info["features"])
    spark = df.sparkSession
    h = F.xxhash64(F.lit(seed), *cols, F.col(label))
    base = df.select(*cols, F.col(label).cast("int").alias("label"), h.alias("_h"))
    base = cut_lineage(base.withColumn("_b", F.shiftright("_h", 52)))
    sizes = base.groupBy("_b").count()  # at most 4096 rows
    before = F.coalesce(F.sum("count").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(W.partitionBy("_b").orderBy("_h", *cols, "label"))
    base = cut_lineage(base.join(F.broadcast(sizes.select("_b", before.alias("_o"))), "_b")
                       .select(*cols, "label", (F.col("_o") + nth - 1).alias("_i")))
    n = base.count()

    def correct(frame):
        s = score_forest(info, frame, "_p")
        return s.withColumn("_ok", ((F.col("_p") >= 0.5).cast("int") == F.col("label")).cast("double"))

    ref = correct(base).agg(F.avg("_ok")).first()[0]
    rng = random.Random(seed)
    draws = []
    for f in cols:
        for rep in range(repeats):
            a = rng.randrange(1, 1 << 20)
            while n and math.gcd(a, n) != 1:
                a += 1
            draws.append((f, rep, a, rng.randrange(max(n, 1))))
    plan = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(r).alias("r"), F.lit(a).cast("long").alias("a"),
                              F.lit(b).cast("long").alias("b")) for f, r, a, b in draws])
    given = base.select(F.col("_i").alias("_from"), *[F.col(c).alias(f"_g_{c}") for c in cols])
    copies = base.withColumn("_d", F.explode(plan))
    copies = copies.withColumn("_from", (F.col("_i") * F.col("_d.a") + F.col("_d.b")) % F.lit(max(n, 1)))
    copies = copies.join(given, "_from").select(
        *[F.when(F.col("_d.f") == c, F.col(f"_g_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
        "label", F.col("_d.f").alias("_f"), F.col("_d.r").alias("_rep"))
    acc = correct(copies).groupBy("_f", "_rep").agg(F.avg("_ok").alias("_acc"))
    return (acc.groupBy(F.col("_f").alias("feature"))
            .agg(F.avg(F.lit(ref) - F.col("_acc")).alias("importance"),
                 F.stddev_pop(F.lit(ref) - F.col("_acc")).alias("std")))
