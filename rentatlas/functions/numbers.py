"""Rounding, NA-poisoned aggregates and value bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column) -> Column:
    """Whole-number rounding with ties to even, so 1250.5 becomes 1250."""
    return F.bround(value, 0)


def na_max(value: Column) -> Column:
    """Maximum that is NULL as soon as one value of the group is NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.max(value))


def null_if_nan(value: Column) -> Column:
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def value_band(value: Column, per_doubling: int = 64) -> Column:
    """Order-preserving band number: equal or larger values never get a smaller band.

    Each band spans about 1 % of the value, and a double can fall in at most a few hundred
    thousand bands, however many distinct values there are.
    """
    offset = 1100 * per_doubling
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(1100.0)) * per_doubling) + offset
    return (
        F.when(value > 0, size)
        .when(value < 0, -size)
        .when(value == 0, F.lit(0).cast("bigint"))
    )
