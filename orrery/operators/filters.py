"""Filters: model filters, rolling date constraints, period predicates, parameters."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.dates import period_index, start_of


@dataclass(frozen=True)
class Filter:
    """`column oper values`; with `tables`, it applies only when one of them takes part.

    Texts of the form MM/DD/YYYY are dates.
    """

    column: str
    oper: str
    values: Sequence
    tables: Sequence[str] = ()

    def predicate(self) -> Column:
        c, v = F.col(self.column), [_filter_value(x) for x in self.values]
        simple = {
            "=": lambda: c == v[0], "!=": lambda: c != v[0],
            ">": lambda: c > v[0], ">=": lambda: c >= v[0],
            "<": lambda: c < v[0], "<=": lambda: c <= v[0],
            "between": lambda: c.between(v[0], v[1]),
            "in": lambda: c.isin(v), "not_in": lambda: ~c.isin(v),
        }
        if self.oper not in simple:
            raise ValueError(f"unknown operator {self.oper}")
        return simple[self.oper]()

    def applies(self, used: Iterable[str]) -> bool:
        return not self.tables or bool(set(self.tables) & set(used))


def _filter_value(v):
    if isinstance(v, str) and re.fullmatch(r"\d{2}/\d{2}/\d{4}", v):
        return F.lit(f"{v[6:]}-{v[:2]}-{v[3:5]}").cast("date")
    return v


def model_filter(df: DataFrame, filters: Sequence[Filter], used_tables: Iterable[str] = ()) -> DataFrame:
    """Apply each filter that is unconditional or scoped to a table in use."""
    used = list(used_tables)
    return reduce(lambda d, f: d.filter(f.predicate()), [f for f in filters if f.applies(used)], df)


def rolling_date_constraint(conditions: Sequence[Sequence[tuple[str, int, str]]], ref: Column) -> Column:
    """Last N periods before the reference date.

    Each entry is a list of (date column, N, DAY..YEAR) joined by OR; entries are joined
    by AND.
    """

    def one(column: str, n: int, bucket: str) -> Column:
        unit = bucket.lower()
        if unit in ("day", "week"):
            low = F.date_sub(ref, n * (7 if unit == "week" else 1))
        else:
            low = F.add_months(ref, -n * {"month": 1, "quarter": 3, "year": 12}[unit])
        return (F.col(column) >= low) & (F.col(column) <= ref)

    return reduce(and_, [reduce(or_, [one(*c) for c in entry]) for entry in conditions])


def last_n_complete_periods(d: Column, unit: str, n: int, ref: Column, include_current: bool = False) -> Column:
    """In the n periods before the one of the reference date; or that one and the n-1 before.

    Written as a range on the date, so that it reaches the parquet scan.
    """
    low = start_of(unit, ref, -(n - 1) if include_current else -n)
    high = start_of(unit, ref, 1 if include_current else 0)
    return (d >= low) & (d < high)


def in_period(d: Column, unit: str, ref: Column, offset: int = 0) -> Column:
    """In the same period as the reference date, shifted by `offset` periods."""
    return (d >= start_of(unit, ref, offset)) & (d < start_of(unit, ref, offset + 1))


def year_to_date_filter(d: Column, ref: Column) -> Column:
    return (d >= start_of("year", ref)) & (d < F.date_add(ref, 1))


def period_distance(d: Column, unit: str, ref: Column) -> Column:
    """How many periods before the reference: 0 is the same period."""
    return period_index(ref, unit) - period_index(d, unit)


@dataclass(frozen=True)
class Parameter:
    """A run-time value: typed, with an optional list or range of allowed values."""

    name: str
    type: str
    default: object
    allowed: Sequence | None = None
    low: object | None = None
    high: object | None = None

    def value(self, given=None) -> Column:
        v = self.default if given is None else given
        if self.allowed is not None and v not in self.allowed:
            raise ValueError(f"{self.name}: {v!r} is not one of {list(self.allowed)}")
        if (self.low is not None and v < self.low) or (self.high is not None and v > self.high):
            raise ValueError(f"{self.name}: {v!r} is outside {self.low}..{self.high}")
        spark_type = {"INT64": "bigint", "DOUBLE": "double", "CHAR": "string", "DATE": "date", "BOOL": "boolean"}
        return F.lit(v).cast(spark_type[self.type])
