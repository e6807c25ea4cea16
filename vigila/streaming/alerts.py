"""Hotspot alerts from incident files arriving in a folder.

File source (X1) -> alias/time normalisation and a 60-minute watermark
(X3) -> cell by arithmetic and a stream-static join with the forecast
grid (X4) -> sliding 60-minute windows per hot cell (X5) -> an alert
table that receives each (cell, window) once (X6) and keeps the history
(X7).  The sink's anti join makes a re-run micro-batch idempotent, and
the query restarts from its checkpoint after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import path_exists
from ..functions.geo import merc_x, merc_y
from ..operators.normalize import parse_time, parse_number
from ..operators.spatial import cell_id
from .progress import PollLog

# Default column layout of arriving files (CSV columns bind by position
# under a given schema, so the folder's layout is part of the stream spec).
DEFAULT_COLUMNS = ("fir_id", "date_time", "crime_type", "latitude", "longitude")

ALERT_SCHEMA = ("cell_id string, window_start timestamp, window_end timestamp, "
                "prob double, n_incidents long, msg string, batch_id long")


def incident_file_stream(spark: SparkSession, folder: str, max_files: int = 5,
                         latest_first: bool = False, columns=DEFAULT_COLUMNS) -> DataFrame:
    """CSV files arriving in ``folder`` with the given column layout
    (all read as text), at most ``max_files`` per micro-batch.
    ``latest_first`` conflicts with a watermark (newest files first would
    make older rows late), so it is off by default."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    r = (spark.readStream.schema(schema).option("header", True)
         .option("maxFilesPerTrigger", max_files))
    if latest_first:
        r = r.option("latestFirst", True)
    return r.csv(folder)


def prepare_incidents(df: DataFrame, watermark: str = "60 minutes") -> DataFrame:
    """lat/lon aliases, parsed time, null times/points dropped, watermark."""
    def pick(*names):
        present = [parse_number(n) for n in names if n in df.columns]
        return F.coalesce(*present) if len(present) > 1 else (present[0] if present else F.lit(None).cast("double"))

    lat = pick("latitude", "lat")
    lon = pick("longitude", "lon")
    # event time must be a session-zone TIMESTAMP for watermarks (UTC session: same wall clock)
    out = df.select(parse_time("date_time").cast("timestamp").alias("date_time"), lat.alias("latitude"),
                    lon.alias("longitude"))
    out = out.where(F.col("date_time").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return out.withWatermark("date_time", watermark)


def grid_parameters(spec: DataFrame) -> dict:
    """The forecast grid's origin and cell size (one bounded row)."""
    r = spec.select("minx", "miny", "size").first()
    return {"minx": r["minx"], "miny": r["miny"], "size": r["size"]}


def alert_counts(stream: DataFrame, grid: DataFrame, params: dict, threshold: float = 0.7,
                 window: str = "60 minutes", slide: str = "5 minutes",
                 prob_col: str = "combined_prob_24h") -> DataFrame:
    """X4 + X5 + F5: incidents per (sliding window, hot cell).  Only cells
    at or above the probability threshold take part (filter before the
    stream-static join, so the static side is just the hot cells)."""
    x = merc_x("longitude")
    y = merc_y("latitude")
    ix = F.floor((x - F.lit(params["minx"])) / F.lit(params["size"]))
    iy = F.floor((y - F.lit(params["miny"])) / F.lit(params["size"]))
    pts = stream.withColumn("cell_id", cell_id(ix, iy))
    hot = grid.where(F.col(prob_col) >= threshold).select("cell_id", F.col(prob_col).alias("prob"))
    j = pts.join(hot, "cell_id")
    return (j.groupBy(F.window("date_time", window, slide).alias("w"), "cell_id", "prob")
            .agg(F.count(F.lit(1)).alias("n_incidents"))
            .select("cell_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "prob", "n_incidents",
                    F.format_string("Emerging hotspot %s prob=%.3f recent_events=%d",
                                    F.col("cell_id"), F.col("prob"), F.col("n_incidents")).alias("msg")))


def alert_sink(table_path: str):
    """X6 + X7: foreachBatch writer appending (cell, window, count) keys not yet
    in the alert table: a window whose count has risen is a new alert.
    Re-running a batch after a failure writes nothing twice (the keys are already
    there); a fault in reading the table ends the batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = ["cell_id", "window_start", "n_incidents"]
        held = batch.persist()  # read twice, and the stateful plan must run once
        try:
            new = held.withColumn("batch_id", F.lit(batch_id).cast("long")).dropDuplicates(key)
            if path_exists(spark, table_path):
                # only alerts at or after the batch's first window can collide;
                # the filter reaches the Parquet scan, so history is not re-read
                first = held.agg(F.min("window_start")).first()[0]
                old = spark.read.parquet(table_path)
                if first is not None:
                    old = old.where(F.col("window_start") >= F.lit(first))
                new = new.join(old.select(*key), key, "left_anti")
            (new.select("cell_id", "window_start", "window_end", "prob", "n_incidents", "msg", "batch_id")
             .write.mode("append").parquet(table_path))
        finally:
            held.unpersist()
    return write


def start_alerts(spark: SparkSession, folder: str, grid: DataFrame, params: dict, table_path: str,
                 checkpoint: str, threshold: float = 0.7, trigger: dict | None = None,
                 max_files: int = 5, columns=DEFAULT_COLUMNS, poll_path: str | None = None, name: str = "alerts"):
    """X1-X7 wired together; ``trigger`` defaults to ``availableNow``
    (use ``{"processingTime": "60 seconds"}`` for a polling cadence, X2).  With
    ``poll_path`` every poll of the query ``name`` is appended to a table there (X7); the
    listener is the query's ``poll_log``."""
    log = PollLog(spark, name, poll_path) if poll_path else None
    if log:
        spark.streams.addListener(log)
    s = prepare_incidents(incident_file_stream(spark, folder, max_files, columns=columns))
    counts = alert_counts(s, grid, params, threshold)
    w = (counts.writeStream.outputMode("update").foreachBatch(alert_sink(table_path))
         .option("checkpointLocation", checkpoint))
    w = w.queryName(name).trigger(**(trigger or {"availableNow": True}))
    query = w.start()
    query.poll_log = log
    return query


def alert_history(spark: SparkSession, table_path: str, n: int = 20) -> DataFrame:
    """The latest ``n`` alerts."""
    return (spark.read.parquet(table_path)
            .orderBy(F.col("window_start").desc(), F.col("cell_id"), F.col("n_incidents").desc()).limit(n))
