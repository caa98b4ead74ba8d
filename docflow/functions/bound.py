"""Values that are computed once per row, however often an expression asks for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
