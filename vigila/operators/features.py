"""Feature preparation.

Statistics (medians, means, standard deviations, category lists) are
computed by distributed aggregates; the driver only receives the scalars
and short category lists needed to write the projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

# Numeric and category columns of the feature table.
NUMERIC_FEATURES = ["duration_seconds_mean", "time_diff_minutes_mean", "distance_m_mean", "hour", "dayofweek"]
CATEGORY_FEATURES = ["crime_type", "victim_gender", "suspect_gender"]

#: Ranges that a column's values are cut into.
MEDIAN_RANGES = 256


def exact_medians(df: DataFrame, cols: list[str]) -> dict:
    """M1: exact medians (mean of the two middle values for an even count) of all
    ``cols`` at once, None for a column without values.

    Equal values are counted first, as one long table of (column, value); approximate
    quantiles cut each column into ranges, the ranges' totals tell which of them hold the
    middle ranks, and running sums are taken in those only: no gathering and no
    one-task sort, however often a value repeats, and one pass for all columns."""
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v"))
                                         for c in cols])).alias("x")).select("x.*")
    counts = cut_lineage(long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("name", "v").agg(F.count("*").alias("c")))
    parts = [i / MEDIAN_RANGES for i in range(1, MEDIAN_RANGES)]
    cuts = {r["name"]: (sorted(set(r["q"])), r["n"]) for r in counts.groupBy("name").agg(
        F.percentile_approx("v", parts, 10_000).alias("q"), F.sum("c").alias("n")).collect()}  # a row a column
    if not cuts:
        return dict.fromkeys(cols)
    bucket = F.lit(0)
    for name, (q, _) in cuts.items():
        place = F.size(F.filter(F.array(*map(F.lit, q)), lambda x: x <= F.col("v")))
        bucket = F.when(F.col("name") == name, place).otherwise(bucket)
    ranged = counts.withColumn("b", bucket)
    totals: dict[str, list] = {}
    for r in ranged.groupBy("name", "b").agg(F.sum("c").alias("n")).orderBy("name", "b").collect():  # ranges x columns
        totals.setdefault(r["name"], []).append((r["b"], r["n"]))
    wanted = F.lit(False)
    before, ranks = F.lit(0), {}
    for name, (_, n) in cuts.items():
        ranks[name] = ((n - 1) // 2, n // 2)  # 0-based middle ranks
        upto = 0
        for b, size in totals[name]:
            if any(upto <= r < upto + size for r in ranks[name]):
                here = (F.col("name") == name) & (F.col("b") == b)
                wanted, before = wanted | here, F.when(here, F.lit(upto)).otherwise(before)
            upto += size
    run = W.partitionBy("name", "b").orderBy("v")
    cum = ranged.where(wanted).withColumn("upto", before + F.sum("c").over(run))
    holds = F.lit(False)
    for name, two in ranks.items():
        for r in set(two):
            holds = holds | ((F.col("name") == name) & (F.col("upto") > r) & (F.col("upto") - F.col("c") <= r))
    got = {r["name"]: (r["lo"], r["hi"]) for r in cum.where(holds).groupBy("name").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    return {c: (got[c][0] + got[c][1]) / 2.0 if c in got else None for c in cols}


def exact_median(df: DataFrame, col: str) -> float | None:
    """M1: exact median of one column."""
    return exact_medians(df, [col])[col]


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """M1: add absent columns as null, then fill nulls with the exact median
    (a column with no values at all stays null, as nothing is learnt).
    Columns without nulls need no statistic and are skipped."""
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    need = [c for c in cols if nulls[c] > 0]
    fills = exact_medians(df, need)
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(fills[c])) if fills.get(c) is not None
                               else F.col(c).cast("double")) for c in cols})


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """M2: (x - mean) / population std, a zero std divides by 1.  The
    statistics come from ``fit_on`` (default: ``df``) as one scalar struct."""
    src = fit_on if fit_on is not None else df
    st = src.select(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                             *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).alias("s")).scalar()
    out = {}
    for i, c in enumerate(cols):
        sd = st[f"s{i}"]
        out[c] = (F.col(c) - st[f"m{i}"]) / F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(sd)
    return df.withColumns(out)


def one_hot(df: DataFrame, cols: list[str], prefix: str = "cat",
            max_columns: int = 2000) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """M3: one indicator column per (column, category), categories sorted
    per column, named ``{prefix}_0..``; absent columns become 'unknown' and
    null counts as the category 'nan', as in the source tool.  Values not seen
    at fit time get all zeros.  Every category becomes a column of the plan, so
    more than ``max_columns`` of them raise.  Returns the frame and the (name,
    column, category) list."""
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("unknown"))
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols}
    cats = reduce(lambda a, b: a.unionByName(b),
                  [df.select(F.lit(c).alias("col"), text[c].alias("val")).distinct() for c in cols]).limit(
                      max_columns + 1).collect()
    if len(cats) > max_columns:
        raise ValueError(f"more than {max_columns} categories in {cols}")
    order = {c: i for i, c in enumerate(cols)}
    spec = sorted(((r["col"], r["val"]) for r in cats), key=lambda t: (order[t[0]], t[1]))
    names = [(f"{prefix}_{i}", c, v) for i, (c, v) in enumerate(spec)]
    return df.withColumns({n: (text[c] == F.lit(v)).cast("double") for n, c, v in names}), names


def incident_features(mapped: DataFrame, crime_col: str = "crime_type") -> DataFrame:
    """M4: hour and weekday (Monday = 0) of the incident, median-imputed and
    standard-scaled call statistics, one-hot categories."""
    # several statistics passes read this table: materialise it once
    df = cut_lineage(mapped.withColumns({"hour": F.hour("date_time").cast("double"),
                                         "dayofweek": F.weekday("date_time").cast("double")}))
    df = impute_median(df, NUMERIC_FEATURES)
    df = standard_scale(df, NUMERIC_FEATURES)
    cats = [crime_col] + [c for c in CATEGORY_FEATURES if c != crime_col]
    df, _ = one_hot(df, cats)
    return df


def zscore_contributions(cells: DataFrame, feature_cols: list[str], topk: int = 6,
                         key: str = "cell_id", eps: float = 1e-9) -> DataFrame:
    """For every cell, the ``topk`` features with the largest absolute
    z-score against all cells (sample std + eps), with the local value.
    The input is read twice (statistics, then scores), so it is
    materialised once."""
    from ..session import cut_lineage
    cells = cut_lineage(cells.select(key, *feature_cols))
    st = cells.select(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(feature_cols)],
                               *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(feature_cols)]).alias("s")
                      ).scalar()
    long = cells.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("local_value"),
                 F.abs((F.col(c) - st[f"m{i}"]) / (F.coalesce(st[f"s{i}"], F.lit(0.0)) + F.lit(eps))).alias("importance"))
        for i, c in enumerate(feature_cols)])).alias("f")).select(key, "f.*")
    w = W.partitionBy(key).orderBy(F.col("importance").desc(), F.col("feature"))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= topk)


RESERVED = {"cell_id", "geometry", "combined_prob_24h", "rf_prob_24h", "kde_score", "lstm_prob_24h"}


def drilldown(cells: DataFrame, reserved=RESERVED) -> DataFrame:
    """Every non-reserved numeric column of each cell in long form
    ``(cell_id, feature, value)``."""
    num = [f.name for f in cells.schema.fields if f.name not in reserved
           and f.dataType.typeName() in ("double", "float", "long", "integer", "short", "decimal")]
    return cells.select("cell_id", *[F.col(c).cast("double").alias(c) for c in num]) \
        .unpivot("cell_id", num, "feature", "value")
