"""Building blocks for expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once; without it nested expressions repeat their operands and explode."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
