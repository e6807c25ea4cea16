"""Counts per (cell, time bin) and the time-window operators on them
(G2, G3, G9, T1-T6).

All windows run on the aggregated (cell, bin) table, whose groups are
bounded by the number of time bins, never by the raw row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.timefn import time_bin, day_index, micros

HISTORY_WINDOWS = (1, 3, 7, 14)


def timecell_counts(assigned: DataFrame, time_col: str = "date_time", hours: int = 24) -> DataFrame:
    """``crime_count`` per (cell_id, time_bin); rows without a cell or
    time are dropped.  Partial aggregation absorbs hot cells map-side."""
    return (assigned.where(F.col("cell_id").isNotNull() & F.col(time_col).isNotNull())
            .groupBy("cell_id", time_bin(time_col, hours).alias("time_bin"))
            .agg(F.count(F.lit(1)).alias("crime_count")))


def cell_counts(assigned: DataFrame) -> DataFrame:
    """Incidents per cell (null cells dropped)."""
    return (assigned.where(F.col("cell_id").isNotNull()).groupBy("cell_id")
            .agg(F.count(F.lit(1)).alias("n_incidents")))


def history_features(counts: DataFrame, windows=HISTORY_WINDOWS, hours: int = 24) -> DataFrame:
    """T2 + T3: trailing sums ``hist_{w}d`` over [bin - w days, bin], both
    ends inclusive, as range frames in seconds, so any bin size counts the same
    days; plus ``hour`` and ``weekday`` (Monday = 0) of the bin."""
    df = counts.withColumn("_t", F.floor(micros("time_bin") / F.lit(1_000_000)).cast("long"))
    base = W.partitionBy("cell_id").orderBy("_t")
    cols = {}
    for w in windows:
        cols[f"hist_{w}d"] = F.sum("crime_count").over(base.rangeBetween(-w * 86_400, 0))
    df = df.withColumns(cols).withColumns({"hour": F.hour("time_bin"), "weekday": F.weekday("time_bin")})
    return df.drop("_t")


def lead_labels(counts: DataFrame, lead_hours: int = 24) -> DataFrame:
    """T4: 1 when the same cell has a positive count at exactly bin +
    lead, else 0 (a self equi-join on (cell, bin + lead), so gaps count)."""
    fut = counts.where(F.col("crime_count") > 0).select(
        "cell_id", (F.col("time_bin") - F.make_dt_interval(F.lit(0), F.lit(lead_hours))).alias("time_bin"),
        F.lit(1).alias("label"))
    return (counts.select("cell_id", "time_bin").join(fut, ["cell_id", "time_bin"], "left")
            .select("cell_id", "time_bin", F.coalesce("label", F.lit(0)).alias("label")))


def horizon_labels(counts: DataFrame, days: int = 7) -> DataFrame:
    """1 when the cell has any count in the next ``days`` bins (the
    true 7-day label), as a forward range frame.  Rows whose horizon runs past
    the last bin have no known label and are left out."""
    df = counts.withColumn("_t", day_index("time_bin").cast("long"))
    last = df.agg(F.max("_t")).scalar()
    w = W.partitionBy("cell_id").orderBy("_t").rangeBetween(1, days)
    df = df.withColumn("_last", last)
    return df.withColumn("_s", F.sum("crime_count").over(w)).where(F.col("_t") + days <= F.col("_last")).select("cell_id", "time_bin",
                     (F.coalesce("_s", F.lit(0)) > 0).cast("int").alias("label_7d"))


def bin_index(counts: DataFrame) -> DataFrame:
    """Observed global bins numbered 0..B-1 in time order.  The table has
    one row per distinct bin (bounded by the time span / bin width)."""
    bins = counts.select("time_bin").distinct()
    return bins.withColumn("bin_no", F.row_number().over(W.orderBy("time_bin")) - 1)


def lag_sequences(counts: DataFrame, seq_len: int = 7) -> DataFrame:
    """T5 in sparse form: for every cell and observed bin position ``t >=
    seq_len``, the counts at positions t-1 .. t-seq_len (``lag_1`` ..
    ``lag_k``, zero-filled) and the ``target`` count at t.

    Each positive count is sent forward to the seq_len positions whose
    window contains it, then summed per (cell, position): rows exist only
    where some lag or the target is non-zero.  The all-zero rows of the
    dense form are implied; :func:`zero_sequence_count` gives how many."""
    bins = bin_index(counts)
    nb = bins.agg(F.max("bin_no")).scalar()
    c = counts.join(bins, "time_bin").select("cell_id", "bin_no", "crime_count")
    sends = c.withColumn("_lag", F.explode(F.sequence(F.lit(0), F.lit(seq_len)))).select(
        "cell_id", (F.col("bin_no") + F.col("_lag")).alias("pos"), "_lag", "crime_count")
    sends = sends.where((F.col("pos") >= seq_len) & (F.col("pos") <= nb))
    agg = sends.groupBy("cell_id", "pos").agg(
        F.sum(F.when(F.col("_lag") == 0, F.col("crime_count")).otherwise(0)).alias("target"),
        *[F.sum(F.when(F.col("_lag") == k, F.col("crime_count")).otherwise(0)).alias(f"lag_{k}")
          for k in range(1, seq_len + 1)])
    return agg.join(bins.withColumnRenamed("bin_no", "pos"), "pos") \
        .select("cell_id", "time_bin", *[f"lag_{k}" for k in range(1, seq_len + 1)],
                F.col("target").cast("long").alias("target"))


def densify(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """G9 long form: every cell x every observed bin, missing counts 0.
    The observed bins (bounded by time span / bin width) are attached to
    each cell as an array and exploded - a generator, not a join."""
    bins = counts.select(F.sort_array(F.collect_set("time_bin")).alias("b")).scalar()
    dense = cells.select("cell_id").withColumn("time_bin", F.explode(bins))
    return (dense.join(counts, ["cell_id", "time_bin"], "left")
            .select("cell_id", "time_bin", F.coalesce("crime_count", F.lit(0)).alias("crime_count")))


def pivot_counts(counts: DataFrame, cell_ids: list[str]) -> DataFrame:
    """G9 wide form for a short, explicit cell list: one row per bin."""
    return counts.groupBy("time_bin").pivot("cell_id", cell_ids).agg(F.sum("crime_count")).na.fill(0)


def minmax_sequences(seqs: DataFrame, seq_len: int = 7, eps: float = 0.0) -> DataFrame:
    """M5: scale every lag and the target by the cell's min and max count
    over the observed bins (per-cell statistics from one aggregate,
    joined back by ``cell_id``; a constant cell maps to 0)."""
    lags = [f"lag_{k}" for k in range(1, seq_len + 1)]
    vals = seqs.select("cell_id", F.explode(F.array(*[F.col(c) for c in lags + ["target"]])).alias("v"))
    st = vals.groupBy("cell_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    rng = F.col("_hi") - F.col("_lo")
    out = seqs.join(st, "cell_id")
    return out.withColumns({c: F.when(rng > 0, (F.col(c) - F.col("_lo")) / (rng + F.lit(eps))).otherwise(F.lit(0.0))
                            for c in lags + ["target"]}).drop("_lo", "_hi")
