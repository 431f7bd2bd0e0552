"""Level-of-detail aggregates: values of one grouping and filter scope beside those of another.

A `Context` holds the model-filtered rows, the dimensions of the query, and its own
filters by column. Every LOD value is grouped first and then joined to the grouped
query result, so only group rows meet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from orrery.operators.keys import join_on
from orrery.session import settled


@dataclass(frozen=True)
class Grouping:
    """Which dimensions an LOD value is grouped by, given those of the query.

    `fixed` replaces them; otherwise `plus`, `minus` and `only` (kept if in the query)
    edit them.
    """

    fixed: tuple[str, ...] | None = None
    plus: tuple[str, ...] = ()
    minus: tuple[str, ...] = ()
    only: tuple[str, ...] | None = None

    def columns(self, dims: Sequence[str]) -> list[str]:
        if self.fixed is not None:
            return list(self.fixed)
        kept = [d for d in dims if d not in self.minus and (self.only is None or d in self.only)]
        return kept + [p for p in self.plus if p not in kept]


@dataclass(frozen=True)
class Scope:
    """Which query filters an LOD value sees.

    `inherit` starts from the query's filters, else from none. `minus` drops filters by
    column, `only` keeps just those on the listed columns, `plus` adds predicates.
    Model filters are part of the rows and always apply.
    """

    inherit: bool = True
    minus: tuple[str, ...] = ()
    only: tuple[str, ...] | None = None
    plus: Mapping[str, Column] = field(default_factory=dict)

    def predicates(self, filters: Mapping[str, Column]) -> list[Column]:
        kept = {
            c: p
            for c, p in (filters if self.inherit else {}).items()
            if c not in self.minus and (self.only is None or c in self.only)
        }
        return list({**kept, **self.plus}.values())


@dataclass(frozen=True)
class Context:
    rows: DataFrame
    dims: tuple[str, ...]
    filters: Mapping[str, Column] = field(default_factory=dict)

    def scoped(self, scope: Scope) -> DataFrame:
        return reduce(DataFrame.filter, scope.predicates(self.filters), self.rows)

    def scoped_predicate(self, scope: Scope) -> Column | None:
        """The scope's filters as one condition; None where it has none."""
        kept = scope.predicates(self.filters)
        return reduce(Column.__and__, kept) if kept else None

    def result(self, measures: Mapping[str, Column]) -> DataFrame:
        """The query itself: filtered rows grouped by its dimensions."""
        return self.scoped(Scope()).groupBy(*self.dims).agg(*[m.alias(n) for n, m in measures.items()])

    def lod(
        self,
        result: DataFrame,
        name: str,
        measure: Column,
        grouping: Grouping = Grouping(),
        scope: Scope = Scope(),
        again=None,
    ) -> DataFrame:
        """Put an LOD value beside each row of the result.

        If the LOD groups by columns outside the query, its values are aggregated a
        second time with `again` (for example `F.avg`) up to the query's dimensions.
        """
        groups = grouping.columns(self.dims)
        fine = self.scoped(scope).groupBy(*groups).agg(measure.alias(name))
        shared = [g for g in groups if g in self.dims]
        if len(shared) < len(groups):
            if again is None:
                raise ValueError(f"{name} groups by {groups}, finer than {list(self.dims)}: say how to aggregate it again")
            fine = fine.groupBy(*shared).agg(again(name).alias(name))
        return join_on(result, fine, shared, "left")


def group_value(df: DataFrame, dims: Sequence[str], measure: Column, to: str) -> DataFrame:
    """A fixed LOD value on every raw row.

    Grouped with partial aggregation, written once, and broadcast only if its counted
    rows are few, so that the raw rows are not shuffled and a hot group is no hot task.
    """
    totals = df.groupBy(*dims).agg(measure.alias(to))
    return join_on(df, settled(totals), list(dims), "left")


def percent_of_total(result: DataFrame, measure: str, to: str) -> DataFrame:
    """Share of the grand total, on grouped rows."""
    whole = result.agg(F.sum(measure)).scalar()
    return result.withColumn(to, F.try_divide(F.col(measure), whole))


def percent_of_group(result: DataFrame, measure: str, group: Sequence[str], to: str) -> DataFrame:
    """Share of the group's total, 0 where that is 0, on grouped rows."""
    totals = result.groupBy(*group).agg(F.sum(measure).alias("_whole"))
    out = join_on(result, totals, list(group), "left")
    return out.withColumn(to, F.coalesce(F.try_divide(F.col(measure), F.col("_whole")), F.lit(0.0))).drop("_whole")


def relative_to_max_date(df: DataFrame, date: str, to: str = "days_before_last") -> DataFrame:
    """Days between each row's date and the latest date of all rows."""
    last = df.agg(F.max(date)).scalar()
    return df.withColumn(to, F.date_diff(last, F.col(date)))
