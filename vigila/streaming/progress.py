"""When the alert stream last looked at its folder, and what it read.

A listener appends a row for every micro-batch, and for every idle poll, of the
queries of one name to a table.  The rows outlive the query, so a restart goes
on in the same table, and a reader needs no handle on the running query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

POLL_SCHEMA = "query string, run_id string, batch_id long, polled_at string, rows long"


class PollLog(StreamingQueryListener):
    """Appends (query, run, batch, time of the poll, rows read) to ``path``; an idle
    poll has no batch and no rows.  Events of other queries are passed over."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path, self.runs = spark, name, path, set()

    def _add(self, run, batch, at, rows):
        (self.spark.createDataFrame([(self.name, str(run), batch, str(at), rows)], POLL_SCHEMA).coalesce(1)
         .write.mode("append").parquet(self.path))

    def onQueryStarted(self, event):
        if event.name == self.name:
            self.runs.add(str(event.runId))

    def onQueryProgress(self, event):
        p = event.progress
        if p.name == self.name:
            self._add(p.runId, p.batchId, p.timestamp, p.numInputRows)

    def onQueryIdle(self, event):
        if str(event.runId) in self.runs:
            self._add(event.runId, None, event.timestamp, 0)

    def onQueryTerminated(self, event):
        self.runs.discard(str(event.runId))


def polls(spark: SparkSession, path: str) -> DataFrame:
    """All polls with their time as a timestamp."""
    return spark.read.schema(POLL_SCHEMA).parquet(path).withColumn("polled_at", F.to_timestamp("polled_at"))


def last_poll(spark: SparkSession, path: str) -> DataFrame:
    """One row per query: last poll, last batch with rows, batches and rows read."""
    some = F.col("rows") > 0
    return polls(spark, path).groupBy("query").agg(
        F.max("polled_at").alias("last_poll"), F.max(F.when(some, F.col("polled_at"))).alias("last_rows_at"),
        F.countDistinct(F.when(some, F.struct("run_id", "batch_id"))).alias("batches"), F.sum("rows").alias("rows"))
