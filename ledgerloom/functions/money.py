"""Amounts: tolerance compares and exact sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def close(a: Column, b: Column, absolute: float = 0.03, relative: float = 0.005) -> Column:
    """Equal within the larger of an absolute and a relative tolerance; null if either is null."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))


def cents(x: Column) -> Column:
    """Two decimals, exact: sums don't depend on the order of rows."""
    return x.cast("decimal(18,2)")
