"""Arithmetic that yields NaN and infinities where the engine would raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def safe_div(a: Column, b: Column) -> Column:
    """``a / b`` as doubles: 0/0 is NaN and x/0 infinite; null if either is null."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / b)


def ratio(methylated: Column, total: Column) -> Column:
    """The raw ratio of a call; NaN at depth 0."""
    return safe_div(methylated, total)


def corrected_ratio(methylated: Column, total: Column, error: Column) -> Column:
    """max(0, (m/t - e) / (1 - e)), NaN at depth 0."""
    return F.greatest(F.lit(0.0), safe_div(ratio(methylated, total) - error, F.lit(1.0) - error))
