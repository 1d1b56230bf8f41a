"""Rounding shared by all metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, places: int) -> Column:
    """Rounds half up on the exact value, the same in every engine."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp01(x: Column) -> Column:
    """x held within 0 and 1; null and not-a-number are 0."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
