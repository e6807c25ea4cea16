"""Salted one-way hashing of identifiers (SHA-256, hex prefix)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_id(c, salt: str, n: int = 16) -> Column:
    """First ``n`` hex digits of sha256(str(value) + salt); null stays null.

    The salt is required: there is no default salt in this library.
    """
    if salt is None or salt == "":
        raise ValueError("a non-empty salt is required")
    return F.substring(F.sha2(F.concat(_c(c).cast("string"), F.lit(salt)), 256), 1, n)


def hash_array(c, salt: str, n: int = 16) -> Column:
    """Hash every element of an array column."""
    if salt is None or salt == "":
        raise ValueError("a non-empty salt is required")
    return F.transform(_c(c), lambda x: F.substring(
        F.sha2(F.concat(x.cast("string"), F.lit(salt)), 256), 1, n))
