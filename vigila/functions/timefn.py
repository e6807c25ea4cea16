"""Time expressions that work on naive (TIMESTAMP_NTZ) and session-zone
timestamps alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c) -> Column:
    """Microseconds since the epoch of the wall-clock value (UTC session)."""
    return F.unix_micros(_c(c).cast("timestamp"))


def day_index(c) -> Column:
    """Whole days since 1970-01-01 of the wall-clock date."""
    return F.unix_date(F.to_date(_c(c)))


def time_bin(c, hours: int = 24) -> Column:
    """Floor a timestamp to a fixed bin of ``hours`` (epoch aligned)."""
    if hours == 24:
        return F.date_trunc("DAY", _c(c)).cast("timestamp_ntz")
    step = hours * 3600 * 1_000_000
    return F.timestamp_micros(F.floor(micros(c) / step) * step).cast("timestamp_ntz")


def minutes_apart(a, b) -> Column:
    """Absolute difference in minutes (fractional)."""
    return F.abs(micros(a) - micros(b)) / F.lit(60_000_000.0)
