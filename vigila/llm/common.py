"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written  # noqa: F401  (for the operators here)

#: One word: a run of characters other than space and the ASCII controls
#: from tab to carriage return (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that part words (fixed value).
BLANKS = " \t\n\x0b\x0c\r"


def text_of(c: Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def n_words(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(WORD)).cast("long")


def let(value: Column, use) -> Column:
    """Bind ``value`` once and use it in a larger expression.  A plain column
    reference inside a lambda may be inlined by the optimizer and then be
    evaluated again for every element; a lambda variable never is."""
    return F.transform(F.array(value), use)[0]


def key_of(c: Column) -> Column:
    """A grouping key for a nullable column: null gets a value of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Mark a written table for broadcast when a count shows at most ``rows``
    rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")
