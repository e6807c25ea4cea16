"""String helpers for list-valued text fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_list(c, sep: str = ";", is_array: bool = False) -> Column:
    """``"a; b;;c"`` -> ``["a", "b", "c"]``: split, trim, drop empties.  An array
    column (``is_array``, from the schema) keeps its members, trimmed."""
    arr = _c(c).cast("array<string>") if is_array else F.split(_c(c).cast("string"), _regex_quote(sep))
    return F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x != "")


def is_array(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.ArrayType)


def clip(c, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(c).cast("string"), 1, n)


def _regex_quote(s: str) -> str:
    import re
    return re.escape(s)
