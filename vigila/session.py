"""Session helpers: a tuned local session for tests/bench, and the
shared checkpoint folder used by iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (the data model has naive
# timestamps), AQE for runtime coalescing and skew splitting.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "vigila", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster, use the
    cluster's session and call :func:`prepare` on it instead."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(CORE_CONF)
    conf.update({
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "16g",
        # remove checkpoint files once their DataFrames are garbage collected
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    })
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume (idempotent): naive UTC
    time, and AQE with the skew split that hot join keys rely on."""
    for k, v in CORE_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for ``DataFrame.checkpoint()``.

    Uses the cluster's ``spark.checkpoint.dir``; only a local master may do
    without one and gets a private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="vigila-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (survives executor loss) of an iterative state."""
    from pyspark import StorageLevel
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    # Persist first: the checkpoint write then reads the cached blocks
    # instead of recomputing the plan a second time.
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def written(df, codec: str = "snappy"):
    """Write ``df`` once to the shared checkpoint folder and read it back: the
    lineage is cut, and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    # the shuffles behind the table are garbage now; without this they keep their
    # disk until the driver happens to collect
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession):
    """Queries built and run in here delete their shuffles as they end, for steps whose
    results are written or collected.  The setting is the session's: what other threads
    build meanwhile is recomputed if it is run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class RoundState:
    """Materialises the state of an iterative job round by round.

    Rounds are persisted; every ``every`` rounds the state is written as a
    reliable checkpoint (shared folder, survives executor loss) and the
    persisted rounds before it are released.  Releasing a round earlier
    would make Spark re-plan every cached round derived from it, so the
    caches are only dropped once the checkpoint has cut the lineage."""

    def __init__(self, every: int = 5, lazy: bool = False):
        self.every = max(1, every)
        self.lazy = lazy
        self.held: list = []
        self.round = 0

    def due(self) -> bool:
        """Whether the next :meth:`keep` will checkpoint."""
        return (self.round + 1) % self.every == 0

    def keep(self, df, force: bool = False):
        """``lazy`` states are only materialised at checkpoints (the rounds
        in between run as one chained job); otherwise each round is
        persisted for a per-round action."""
        from pyspark import StorageLevel
        self.round += 1
        if force or self.round % self.every == 0:
            out = cut_lineage(df)
            self.release()
            return out
        if self.lazy:
            return df
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(df)
        return df

    def release(self):
        for d in self.held:
            d.unpersist(blocking=False)
        self.held = []
