"""Scalar helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 4) -> Column:
    """Half up on the binary value; the same in every engine, unlike their own ``round``."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def argmax(values: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
