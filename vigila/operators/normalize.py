"""Schema normalisation and cleaning.

Alias resolution is column-level (the first alias present in the input
schema wins), done on the driver from ``df.columns`` only: it decides the
projection, the data never leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import point
from ..functions.text import is_array, split_list

# Alias lists for incident and call inputs, in priority order.
INCIDENT_ALIASES = {
    "date_time": ["date_time", "date", "datetime", "reported_at", "incident_time"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon"],
    "crime_type": ["crime_type", "offence"],
    "accused_list": ["accused_list", "accused", "accused_party", "persons"],
    "victim_list": ["victim_list", "victim"],
}
CALL_ALIASES = {
    "start_time": ["start_time", "date_time", "start", "call_time", "timestamp"],
    "tower_lat": ["tower_lat", "latitude", "lat"],
    "tower_lon": ["tower_lon", "longitude", "lon"],
    "receiver_id": ["receiver_id", "callee_id"],
}

INCIDENT_TYPES = {"fir_id": "string", "date_time": "timestamp_ntz", "crime_type": "string",
                  "latitude": "double", "longitude": "double"}
# Person lists are kept only when the input has them (no all-null columns
# that later stages would scan and explode for nothing).
LIST_COLS = ("accused_list", "victim_list")
CALL_TYPES = {"cdr_id": "string", "caller_id": "string", "receiver_id": "string",
              "start_time": "timestamp_ntz", "duration_seconds": "double",
              "tower_lat": "double", "tower_lon": "double", "imei": "string"}


def ensure_cols(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Add absent columns as typed nulls."""
    missing = {c: F.lit(None).cast(t) for c, t in spec.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def _first_present(df: DataFrame, names: list[str]):
    lower = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in lower:
            return F.col(lower[n.lower()])
    return None


def parse_time(c):
    """Text or timestamp -> TIMESTAMP_NTZ, unparsable -> null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz"),
                      F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz"))


def parse_number(c):
    """Text or number -> double, unparsable -> null."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string").try_cast("double")


def _apply_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    out = {}
    for target, names in aliases.items():
        col = _first_present(df, names)
        if col is not None:
            out[target] = col
    return df.withColumns(out) if out else df


def source_order():
    """Order of rows in their source: file name, place of the split, row in the
    split.  To be taken right after the scan, before any shuffle."""
    return F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def with_row_order(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds :func:`source_order` as a column."""
    return df.withColumn(name, source_order())


def content_id(df: DataFrame, source: str | None = None):
    """An id from the row's content: hash of source and all columns, then
    the occurrence number within equal rows.  Sources never collide, and a
    different file split gives the same ids."""
    names = sorted(df.columns)
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(source or ""), *(
        [F.col("source").cast("string")] if "source" in names else []),
        F.to_json(F.struct(*names), {"ignoreNullFields": "false"})), 256), 1, 16)
    nth = F.row_number().over(W.partitionBy(digest).orderBy(digest))
    return F.concat_ws("-", digest, nth.cast("string"))


def normalize_incidents(df: DataFrame, source: str | None = None) -> DataFrame:
    """Canonical incident columns.

    ``crime_type`` falls back to ``offence`` then ``'unknown'``; a missing
    ``fir_id`` becomes a content id; ``accused_list`` / ``victim_list`` come
    from their aliases, as text or as arrays.  Adds ``point``."""
    df = _apply_aliases(df, INCIDENT_ALIASES)
    if "fir_id" not in df.columns:
        df = df.withColumn("fir_id", content_id(df, source))
    if "crime_type" not in df.columns:
        df = df.withColumn("crime_type", F.lit("unknown"))
    df = ensure_cols(df, INCIDENT_TYPES)
    df = df.withColumns({
        "fir_id": F.col("fir_id").cast("string"),
        "date_time": parse_time("date_time"),
        "latitude": parse_number("latitude"),
        "longitude": parse_number("longitude"),
        **{c: F.col(c).cast("array<string>" if is_array(df, c) else "string") for c in LIST_COLS if c in df.columns},
    })
    if source is not None:
        df = df.withColumn("source", F.lit(source))
    return df.withColumn("point", point("longitude", "latitude"))


def normalize_calls(df: DataFrame, source: str | None = None) -> DataFrame:
    """S3 (+ ``callee_id`` -> ``receiver_id``), S4, S7, S8, S9, S13."""
    df = _apply_aliases(df, CALL_ALIASES)
    if "cdr_id" not in df.columns:
        df = df.withColumn("cdr_id", content_id(df, source))
    df = ensure_cols(df, CALL_TYPES)
    df = df.withColumns({
        "cdr_id": F.col("cdr_id").cast("string"),
        "caller_id": F.col("caller_id").cast("string"),
        "receiver_id": F.col("receiver_id").cast("string"),
        "start_time": parse_time("start_time"),
        "duration_seconds": parse_number("duration_seconds"),
        "tower_lat": parse_number("tower_lat"),
        "tower_lon": parse_number("tower_lon"),
    })
    if source is not None:
        df = df.withColumn("source", F.lit(source))
    return df.withColumn("point", point("tower_lon", "tower_lat"))


def dedupe_first(df: DataFrame, key: str, order, keep_order: bool = True) -> DataFrame:
    """Keep the first row per key by ``order``.  ``min_by`` is a partial
    aggregate: a key repeated in a third of all rows is reduced map-side
    to one row per task before the shuffle (no skewed window).  Without
    ``keep_order`` a column that gives the order is left out of the result."""
    others = [c for c in df.columns if c != key and (keep_order or c != order)]
    order = F.col(order) if isinstance(order, str) else order
    return (df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r"))
              .select(key, "_r.*"))


def clean_incidents(df: DataFrame, order: str | None = None, filter_first: bool = False) -> DataFrame:
    """lower/trim ``crime_type`` (S10), keep the first row per
    ``fir_id`` (S11), drop null times (S12), parse coordinates (S9) and
    build the point (S13).  First means first in the source, or by ``order``;
    a first row with a bad time is dropped with its duplicates.  Duplicates are
    removed before the null-time filter, as in the source tool; ``filter_first``
    swaps the two."""
    df = df.withColumn("crime_type", F.trim(F.lower(F.col("crime_type"))))
    # a struct is never null, so that min_by skips no row
    order_col = F.struct(order) if order else source_order()
    if filter_first:
        df = df.where(F.col("date_time").isNotNull())
    # the point is built again from the coordinates: it is not shuffled
    df = dedupe_first(df.withColumn("_ord", order_col).drop("point"), "fir_id", "_ord", keep_order=False)
    df = df.where(F.col("date_time").isNotNull())
    df = df.withColumns({"latitude": parse_number("latitude"), "longitude": parse_number("longitude")})
    return df.withColumn("point", point("longitude", "latitude"))


def clean_calls(df: DataFrame) -> DataFrame:
    """Drop null start times, parse tower coordinates, build the point."""
    df = df.where(F.col("start_time").isNotNull())
    df = df.withColumns({"tower_lat": parse_number("tower_lat"), "tower_lon": parse_number("tower_lon")})
    return df.withColumn("point", point("tower_lon", "tower_lat"))


def explode_list(df: DataFrame, col: str, out: str, sep: str = ";") -> DataFrame:
    """One row per non-empty trimmed member of a ``;`` list."""
    return df.withColumn(out, F.explode(split_list(col, sep, is_array(df, col))))


def fill_defaults(df: DataFrame, number: float = 0.0, text: str = "unk") -> DataFrame:
    """Numeric nulls -> ``number``, string nulls -> ``text``."""
    return df.na.fill(number).na.fill(text)


def quality_counts(incidents: DataFrame, calls: DataFrame) -> DataFrame:
    """One-pass data-quality counts per kind."""
    i = incidents.agg(F.lit("FIR").alias("kind"), F.count(F.lit(1)).alias("n_rows"),
                      F.count_if(F.col("date_time").isNull()).alias("n_null_time"),
                      F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull())
                      .alias("n_null_geometry"))
    c = calls.agg(F.lit("CDR").alias("kind"), F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.col("start_time").isNull()).alias("n_null_time"),
                  F.count_if(F.col("tower_lat").isNull() | F.col("tower_lon").isNull())
                  .alias("n_null_geometry"))
    return i.unionByName(c)


def schema_diff(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """S19 "validate schema": expected columns with presence and actual type."""
    spark = df.sparkSession
    actual = {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}
    rows = [(c, t, actual.get(c.lower()), c.lower() in actual) for c, t in expected.items()]
    return spark.createDataFrame(rows, "column string, expected string, actual string, present boolean")
