"""Naming a value inside a column expression, so that what uses it often doesn't hold it often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which stands in the expression once. No Python function may be called inside body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
