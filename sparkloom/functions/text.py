"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space at both ends, for any Unicode white space (trim() knows spaces only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    """Whether null or nothing but white space."""
    return x.isNull() | (F.length(strip(x)) == 0)


def trim_left(x: Column, limit: int, marker: str = "[truncated]\n") -> Column:
    """The last ``limit`` characters after a marker line, where x is longer; the marker comes on top."""
    return F.when(F.length(x) > limit, F.concat(F.lit(marker), F.right(x, F.lit(limit)))).otherwise(x)
