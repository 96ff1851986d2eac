"""Missing-value rules of the analytics, as aggregate and scalar Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_sum(flag: Column) -> Column:
    """Number of true flags; NULL as soon as one flag in the group is unknown."""
    hits = F.coalesce(F.sum(flag.cast("long")), F.lit(0).cast("long"))
    return F.when(F.count_if(flag.isNull()) == 0, hits)


def sum_or_zero(value: Column) -> Column:
    """Null-skipping sum; a group without any known value sums to 0."""
    return F.coalesce(F.sum(value), F.lit(0))


def count_true(flag: Column) -> Column:
    return F.count_if(flag).cast("long")


def mean_of(value: Column) -> Column:
    """Null-skipping mean of numbers or booleans, always DOUBLE."""
    return F.avg(value.cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields NULL on a zero denominator, also under ANSI."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def or_false(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def member_of(value: Column, allowed: list) -> Column:
    """Membership in a literal set; an unknown value is not a member."""
    return or_false(value.isin(*allowed))
