"""Aggregates, statistics and ordering helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values, sorted."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def time_span(*frames_and_cols) -> DataFrame:
    """Global min/max time over several (df, col) inputs."""
    parts = [df.select(F.col(c).alias("t")) for df, c in frames_and_cols]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(F.min("t").alias("min_time"), F.max("t").alias("max_time"))


def zscores(df: DataFrame, cols: list[str], eps: float = 1e-9) -> DataFrame:
    """(x - mean) / (sample std + eps) per column, statistics as one
    scalar-subquery struct."""
    st = df.select(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols],
                            *[F.stddev_samp(c).alias(f"s_{c}") for c in cols])).scalar()
    return df.withColumns({f"z_{c}": (F.col(c) - st[f"m_{c}"]) / (F.coalesce(st[f"s_{c}"], F.lit(0.0))
                                                                  + F.lit(eps)) for c in cols})


def top_k(df: DataFrame, score: str, k: int, tie: str | list[str] = "id") -> DataFrame:
    """The ``k`` highest scores with a deterministic tie-break
    (planned as ``TakeOrderedAndProject``: per-task top k, then merge)."""
    ties = [tie] if isinstance(tie, str) else list(tie)
    return df.orderBy(F.col(score).desc_nulls_last(), *[F.col(t) for t in ties]).limit(k)


def top_k_per_group(df: DataFrame, group: str, score: str, k: int, tie: str) -> DataFrame:
    """Top ``k`` rows per group by ``score`` desc, ``tie`` asc."""
    w = W.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hash_sample(df: DataFrame, n: int, cols: list[str], seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows without replacement - rank by
    a seeded 64-bit hash of the key columns and keep the first ``n``."""
    return (df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]))
            .orderBy("_h", *cols).limit(n).drop("_h"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts."""
    n_edges = edges.agg(F.count(F.lit(1))).scalar()
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).withColumn("n_edges", n_edges)


def prefix_sums(df: DataFrame, order: str, cols: list[str], descending: bool = False,
                inclusive: bool = True, buckets: int = 256) -> DataFrame:
    """Running sums of ``cols`` in ``order`` without a single-task window.

    The order column is cut into ``buckets`` ranges by ``percentile_approx``;
    per-bucket totals (a table of at most ``buckets`` rows) give each
    bucket's offset, and the running sum inside a bucket is a window
    partitioned by the bucket.  Rows with equal ``order`` values must be
    pre-aggregated (one row per value), as for distinct scores.
    Adds ``cum_{c}`` columns (inclusive or exclusive of the row)."""
    key = F.col(order) if not descending else -F.col(order)
    d = df.withColumn("_k", key.cast("double"))
    qs = d.agg(F.percentile_approx("_k", [i / buckets for i in range(1, buckets)], 10_000).alias("q")).first()["q"]
    cuts = sorted(set(qs or []))
    # bucket = number of cut points below the key (one array literal and a
    # HOF keep the generated code small)
    arr = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    d = d.withColumn("_b", F.size(F.filter(arr, lambda c: c < F.col("_k"))))
    tot = d.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wb = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offs = tot.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}") for c in cols])
    frame = (W.unboundedPreceding, W.currentRow) if inclusive else (W.unboundedPreceding, -1)
    wl = W.partitionBy("_b").orderBy("_k").rowsBetween(*frame)
    d = d.join(F.broadcast(offs), "_b")
    return d.withColumns({f"cum_{c}": F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(wl), F.lit(0)) for c in cols}) \
        .drop("_k", "_b", *[f"_o_{c}" for c in cols])
