"""Aggregate expressions beyond Spark's own names: conditional, once-per-key, unique-value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sum_if(cond: Column, x: Column) -> Column:
    return F.sum(F.when(cond, x))


def count_if(cond: Column, x: Column) -> Column:
    """Non-null values of x where the condition holds."""
    return F.count(F.when(cond, x))


def unique_count_if(cond: Column, x: Column) -> Column:
    return F.count_distinct(F.when(cond, x))


def average_if(cond: Column, x: Column) -> Column:
    return F.avg(F.when(cond, x))


def min_if(cond: Column, x: Column) -> Column:
    return F.min(F.when(cond, x))


def max_if(cond: Column, x: Column) -> Column:
    return F.max(F.when(cond, x))


def stddev_if(cond: Column, x: Column) -> Column:
    return F.stddev_samp(F.when(cond, x))


def variance_if(cond: Column, x: Column) -> Column:
    return F.var_samp(F.when(cond, x))


def only(x: Column) -> Column:
    """The value if the group holds a single distinct one, else NULL. NULLs do not count."""
    return F.when(F.min(x) == F.max(x), F.max(x))


def count_duplicates(x: Column) -> Column:
    """Rows beyond the first of each value."""
    return F.count(x) - F.count_distinct(x)


def weighted_average(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def ratio_of_sums(num: Column, den: Column) -> Column:
    """The same definition at every grain: never an average of ratios."""
    return F.try_divide(F.sum(num).cast("double"), F.sum(den).cast("double"))


def average_per(x: Column, member: Column) -> Column:
    """Total per distinct member."""
    return F.try_divide(F.sum(x).cast("double"), F.count_distinct(member))
