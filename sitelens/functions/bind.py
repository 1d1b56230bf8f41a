"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a value used n times in each of k steps would else be written out n ** k times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
