"""Values that may be unknown or only a lower bound: thresholds, sums, votes, order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_least(value: Column, limit: float, partial: Column | None = None) -> Column:
    """true, false or null (unknown). A lower bound below the limit decides nothing."""
    sure = F.coalesce(partial, F.lit(False)) if partial is not None else F.lit(False)
    return F.when(value >= limit, True).when(value.isNull() | sure, None).otherwise(False)


def assess(tests: list[Column], mode: str = "any") -> Column:
    """kept, rejected or review, by three-valued or / and of the tests; no tests keep everything."""
    if not tests:
        return F.lit("kept")
    both = reduce(lambda a, b: a | b if mode == "any" else a & b, tests)
    return F.when(both, "kept").when(~both, "rejected").otherwise("review")


def bounded_sum(value: Column, partial: Column) -> tuple[Column, Column]:
    """(sum of the known values, whether it is only a lower bound)."""
    return F.sum(value), F.coalesce(F.bool_or(value.isNull() | F.coalesce(partial, F.lit(False))), F.lit(False))


def unknown_last(value: str, descending: bool = True) -> Column:
    """Sort order in which unknown and NaN values come last, whatever the direction."""
    known = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return known.desc_nulls_last() if descending else known.asc_nulls_last()
