"""Values of several groupings and filter scopes from one pass over the rows.

Every declared measure is a sum of parts (`rollups`). One grouping, to all columns that any value is grouped by,
computes each part once per filter scope as a conditional aggregate; everything else is regrouped from there.
Where all values share the question's own grouping that is the result, planned as one lazy aggregate. Coarser or
finer values are regrouped from the grouped rows, which are written once, so that the tables are read once
and only grouped rows meet in joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from orrery.operators.keys import join_on
from orrery.operators.lod import Context, Grouping, Scope
from orrery.operators.rollups import COMBINE, Measure, stored
from orrery.session import settled


@dataclass(frozen=True)
class Value:
    """A measure under its own grouping and filter scope; by default those of the question.

    `again` aggregates a value that is grouped more finely than the question; `then` is applied last, as to round.
    """

    measure: Measure
    grouping: Grouping = Grouping()
    scope: Scope = Scope()
    again: Callable[[Column], Column] | None = None
    then: Callable[[Column], Column] = lambda c: c

    @property
    def name(self) -> str:
        return self.measure.name


@dataclass(frozen=True)
class _Parts:
    """The columns that keep a value in the finest grouping: parts, and how many rows its scope sees."""

    value: Value
    number: int
    keep: Column | None

    def __post_init__(self):
        object.__setattr__(self, "plan", stored(replace(self.value.measure, name=f"_v{self.number}")))

    @property
    def seen(self) -> str:
        return f"_seen{self.number}"

    def first(self) -> list[Column]:
        when = (lambda c: c) if self.keep is None else (lambda c: F.when(self.keep, c))
        return [COMBINE[c.func](when(F.col(c.column))).alias(c.alias) for c in self.plan.components] + [F.count(when(F.lit(1))).alias(self.seen)]

    def regrouped(self, rows: DataFrame, groups: Sequence[str]) -> DataFrame:
        """`groups` and the value, under its name, for the groups its scope sees."""
        mine = rows.where(F.col(self.seen) > 0)
        if self.plan.requires:  # a distinct count, whose column is one of the finest grouping's
            found = mine.select(*groups, F.col(self.plan.requires).alias("_one")).distinct() \
                .groupBy(*groups).agg(F.count("_one").alias(self.plan.measure.name))
        else:
            found = mine.groupBy(*groups).agg(*[COMBINE[c.again](c.alias).alias(c.alias) for c in self.plan.components])
        kept = self.plan.finish() if self.plan.decomposable else F.col(self.plan.measure.name)
        return found.select(*groups, self._counted(kept, groups).alias(self.value.name))

    def finished(self, groups: Sequence[str]) -> Column:
        """The value of a group of the finest grouping itself; NULL where its scope sees no row."""
        return self._counted(F.when(F.col(self.seen) > 0, self.plan.finish()), groups).alias(self.value.name)

    def _counted(self, value: Column, groups: Sequence[str]) -> Column:
        """A count over everything is 0 where there are no rows."""
        return F.coalesce(value, F.lit(0)) if self.value.measure.kind == "COUNT" and not groups else value


def beside(ctx: Context, values: Sequence[Value]) -> DataFrame:
    """The question's rows, one for each group of its dimensions that its filters leave, with every value.

    A value whose scope sees no row of its group is NULL. A value grouped by columns outside the question
    needs `again`.
    """
    dims = list(ctx.dims)
    ask = ctx.scoped_predicate(Scope())
    parts = [_Parts(v, i, ctx.scoped_predicate(v.scope)) for i, v in enumerate(values)]
    groups = [v.grouping.columns(dims) for v in values]
    for v, g in zip(values, groups):
        if v.again is None and not set(g) <= set(dims):
            raise ValueError(f"{v.name} groups by {g}, finer than {dims}: say how to aggregate it again")
    finest = list(dict.fromkeys([*dims, *(c for g in groups for c in g), *(p.plan.requires for p in parts if p.plan.requires)]))
    scopes = [ask, *(p.keep for p in parts)]
    rows = ctx.rows if any(s is None for s in scopes) else ctx.rows.where(reduce(or_, scopes))
    asked = F.count(F.lit(1) if ask is None else F.when(ask, 1)).alias("_asked")
    grouped = rows.groupBy(*finest).agg(asked, *[c for p in parts for c in p.first()])

    names = [v.then(F.col(v.name)).alias(v.name) for v in values]
    own = [set(g) == set(dims) and not p.plan.requires for p, g in zip(parts, groups)]
    left = (lambda df: df.where("_asked > 0")) if dims else (lambda df: df)  # a grand total is a row even of no rows
    if all(own):
        return left(grouped).select(*dims, *[p.finished(dims) for p in parts]).select(*dims, *names)
    grouped = settled(grouped)
    out = left(grouped).groupBy(*dims).agg(F.sum("_asked").alias("_asked")).drop("_asked")
    for p, g in zip(parts, groups):
        found, shared = p.regrouped(grouped, g), [c for c in g if c in dims]
        if len(shared) < len(g):
            found = found.groupBy(*shared).agg(p.value.again(F.col(p.value.name)).alias(p.value.name))
        out = join_on(out, found, shared, "left")
    return out.select(*dims, *names)


def without(measure: Measure, columns: Sequence[str], then: Callable[[Column], Column] = lambda c: c) -> Value:
    """The measure as if the columns were neither grouped by nor filtered on."""
    gone = tuple(columns)
    return Value(measure, Grouping(minus=gone), Scope(minus=gone), then=then)


def reselected(
    ctx: Context, measure: Measure, replace: dict | None = None, add: dict | None = None, remove: dict | None = None,
    everything: bool = False, then: Callable[[Column], Column] = lambda c: c,
) -> Value:
    """The measure under an edited selection: `replace` selects other values for a column, `add` and `remove` change
    the selected values, `everything` ignores the selection first."""
    base = {} if everything else dict(ctx.filters)
    for c, v in (replace or {}).items():
        base[c] = F.col(c).isin(list(v))
    for c, v in (add or {}).items():
        if c in base:
            base[c] = base[c] | F.col(c).isin(list(v))
    for c, v in (remove or {}).items():
        keep = ~F.col(c).isin(list(v))
        base[c] = base[c] & keep if c in base else keep
    return Value(measure, scope=Scope(inherit=False, plus=base), then=then)

