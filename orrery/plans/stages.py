"""Stages of a model question: values beside its rows that are computed from other questions or over its result.

A stage is asked of the same model by the same user, so that row rules, column rules and filters hold in it
as in the question. Stages are applied in the order they are given and may use what earlier ones added.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from orrery.operators import lod as L, windows as V
from orrery.operators.keys import join_on
from orrery.operators.lod import Grouping
from orrery.operators.sets import topn_with_others

# A question of the same model and user: attributes, measures, filters (None for those of the question).
Ask = Callable[[Sequence[str], Sequence[str], Sequence | None], DataFrame]


@dataclass(frozen=True)
class Question:
    """What stages see of the question they belong to."""

    attributes: tuple[str, ...]
    filters: tuple
    ask: Ask


@dataclass(frozen=True)
class Level:
    """A measure at another level of detail, beside each row.

    `grouping` edits the question's attributes; `filtered` False leaves the question's filters out, and `filters`
    are added. A finer value is aggregated `again` (SUM, AVG, MIN or MAX) up to the attributes.
    """

    name: str
    measure: str
    grouping: Grouping = Grouping()
    filtered: bool = True
    filters: tuple = ()
    again: str | None = None

    def apply(self, out: DataFrame, q: Question) -> DataFrame:
        groups = self.grouping.columns(q.attributes)
        shared = [g for g in groups if g in q.attributes]
        fine = q.ask(groups, [self.measure], [*(q.filters if self.filtered else ()), *self.filters]).withColumnRenamed(self.measure, self.name)
        if len(shared) < len(groups):
            if self.again is None:
                raise ValueError(f"{self.name} groups by {groups}, finer than {list(q.attributes)}: say how to aggregate it again")
            fn = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[self.again]
            fine = fine.groupBy(*shared).agg(fn(self.name).alias(self.name))
        return join_on(out, fine, shared, "left")


@dataclass(frozen=True)
class Share:
    """A measure's share of its total over the result, or over the rows with equal `of` attributes."""

    name: str
    measure: str
    of: tuple[str, ...] = ()

    def apply(self, out: DataFrame, q: Question) -> DataFrame:
        if not self.of:
            return L.percent_of_total(out, self.measure, self.name)
        return L.percent_of_group(out, self.measure, self.of, self.name)


@dataclass(frozen=True)
class Running:
    """A measure added up (or SUM, AVG, MIN, MAX over `rows` rows: before and after) along `order`, by `by`.

    The window is over grouped rows. Without `by` they are put in order in one task: keep to orders of few
    values, such as dates.
    """

    name: str
    measure: str
    order: tuple[str, ...]
    by: tuple[str, ...] = ()
    fn: str = "SUM"
    rows: tuple[int, int] | None = None

    def apply(self, out: DataFrame, q: Question) -> DataFrame:
        fn = self.fn.lower()
        value = V.cumulative(fn, self.measure, self.order, self.by) if self.rows is None else V.moving(fn, self.measure, *self.rows, self.order, self.by)
        return out.withColumn(self.name, value)


@dataclass(frozen=True)
class Rank:
    """The rank of each row by a measure, over all rows (by value ranges) or among rows with equal `by` attributes."""

    name: str
    measure: str
    by: tuple[str, ...] = ()
    descending: bool = True

    def apply(self, out: DataFrame, q: Question) -> DataFrame:
        if self.by:
            return out.withColumn(self.name, V.rank_partitioned(self.measure, self.by, self.descending))
        return V.rank(out, self.measure, self.descending, self.name)


@dataclass(frozen=True)
class Members:
    """Only the rows of an attribute's first `n` members by a measure, or of those that meet a `condition` (a SQL text
    over the attribute and the measure). Ties at the last place go to the smaller member.

    Members are chosen by a question of their own, grouped by the attribute alone, under the question's filters.
    With `inside` in place of a filter, all rows stay and the column tells whether they are of the set.
    """

    attribute: str
    measure: str
    n: int | None = None
    top: bool = True
    condition: str | None = None
    inside: str | None = None

    def apply(self, out: DataFrame, q: Question) -> DataFrame:
        members = q.ask([self.attribute], [self.measure], None)
        if self.condition is not None:
            members = members.where(self.condition)
        if self.n is not None:
            by = F.col(self.measure).desc_nulls_last() if self.top else F.col(self.measure).asc_nulls_last()
            members = members.orderBy(by, self.attribute).limit(self.n)
        chosen = members.select(F.col(self.attribute).alias("_member"), F.lit(True).alias("_in"))
        met = out.join(chosen, F.col(self.attribute).eqNullSafe(F.col("_member")), "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
        if self.inside is not None:
            return met.withColumn(self.inside, F.col("_in")).drop("_member", "_in")
        return met.where("_in").drop("_member", "_in")


@dataclass(frozen=True)
class Others:
    """The first `n` members of the question's one attribute by a summed measure, all others as one row."""

    attribute: str
    measure: str
    n: int
    label: str = "Others"

    def apply(self, out: DataFrame, q: Question) -> DataFrame:
        if q.attributes != (self.attribute,):
            raise ValueError("others are told apart in a question with one attribute")
        return topn_with_others(out.select(self.attribute, self.measure), self.attribute, self.measure, self.n, self.label)


@dataclass(frozen=True)
class Computed:
    """A SQL text over the question's columns and those of earlier stages."""

    name: str
    expr: str

    def apply(self, out: DataFrame, q: Question) -> DataFrame:
        return out.withColumn(self.name, F.expr(self.expr))


Stage = Level | Share | Running | Rank | Members | Others | Computed

