"""A value that is computed once and used in a lambda."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once; an expression that a lambda names is computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
