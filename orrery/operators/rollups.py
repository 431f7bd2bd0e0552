"""Rollups: measures as additive components, building, answering from and checking them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.dates import BUCKETS, date_bucket
from orrery.operators.joins import drill_across
from orrery.session import settled


@dataclass(frozen=True)
class Measure:
    """A measure by kind: SUM, MIN, MAX, COUNT, AVG, RATIO, UNIQUE_COUNT or LAST_VALUE.

    `column` is its input; RATIO also has `per`, LAST_VALUE a date in `over`. A RATIO divides
    `of` its column by `per_of` the other, each SUM or COUNT; with `safe` it is 0 on a zero
    divisor, else NULL.
    """

    name: str
    kind: str
    column: str
    per: str | None = None
    over: str | None = None
    safe: bool = False
    of: str = "SUM"
    per_of: str = "SUM"

    def direct(self) -> Column:
        """The measure computed from base rows."""
        c = F.col(self.column)
        if self.kind == "RATIO":
            return self._divide(COMBINE[self.of](c), COMBINE[self.per_of](self.per)).alias(self.name)
        fn = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "AVG": F.avg, "UNIQUE_COUNT": F.count_distinct}
        return fn[self.kind](c).alias(self.name)

    def _divide(self, a: Column, b: Column) -> Column:
        out = F.try_divide(a.cast("double"), b.cast("double"))
        return F.coalesce(out, F.lit(0.0)) if self.safe else out


@dataclass(frozen=True)
class Component:
    """One stored column of a measure: its function over base rows and over rollup rows."""

    alias: str
    func: str
    column: str
    again: str


@dataclass(frozen=True)
class Plan:
    """How a measure is stored. Without components, `requires` names the column the grain must hold."""

    measure: Measure
    components: tuple[Component, ...] = ()
    requires: str | None = None

    @property
    def decomposable(self) -> bool:
        return bool(self.components)

    def finish(self) -> Column:
        """The measure from its re-aggregated components."""
        m, names = self.measure, [c.alias for c in self.components]
        if m.kind == "AVG":
            return F.try_divide(F.col(names[0]).cast("double"), F.col(names[1])).alias(m.name)
        if m.kind == "RATIO":
            return m._divide(F.col(names[0]), F.col(names[1])).alias(m.name)
        return F.col(names[0]).alias(m.name)


# Stored parts of each kind: suffix of the name, function (or the measure's field that names it),
# and the measure's field that holds the input. Kinds without parts name the field of the
# column that the grain must hold instead: a distinct count is no sum over rows, a last value none over time.
PARTS = {
    "SUM": [("sum", "SUM", "column")],
    "MIN": [("min", "MIN", "column")],
    "MAX": [("max", "MAX", "column")],
    "COUNT": [("cnt", "COUNT", "column")],
    "AVG": [("sum", "SUM", "column"), ("cnt", "COUNT", "column")],
    "RATIO": [("num", "of", "column"), ("den", "per_of", "per")],
}
IN_GRAIN = {"UNIQUE_COUNT": "column", "LAST_VALUE": "over"}
# How a stored part is put together again.
AGAIN = {"SUM": "SUM", "COUNT": "SUM", "MIN": "MIN", "MAX": "MAX"}


def stored(m: Measure) -> Plan:
    """How a measure is kept in a rollup."""
    if m.kind not in PARTS | IN_GRAIN:
        raise ValueError(f"unknown measure kind {m.kind}")
    parts = []
    for suffix, func, source in PARTS.get(m.kind, []):
        func = getattr(m, func, func)
        parts.append(Component(f"{m.name}_{suffix}", func, getattr(m, source), AGAIN[func]))
    return Plan(m, tuple(parts), None if parts else getattr(m, IN_GRAIN[m.kind]))


COMBINE = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count}


def build_rollup(df: DataFrame, dims: Sequence[str], grains: Mapping[str, str | None], measures: Sequence[Measure]) -> DataFrame:
    """Group to dims and date buckets with every component; a None bucket keeps the raw date.

    The columns that distinct counts need must be among the dims.
    """
    plans = [stored(m) for m in measures]
    lacking = [p.requires for p in plans if p.requires and p.requires not in dims]
    if lacking:
        raise ValueError(f"the grain lacks {lacking}")
    keys = [*dims, *[(F.col(c) if b is None else date_bucket(F.col(c), b)).alias(c) for c, b in grains.items()]]
    parts = {c.alias: COMBINE[c.func](c.column).alias(c.alias) for p in plans for c in p.components}
    return df.groupBy(*keys).agg(*(parts.values() or [F.count("*").alias("rows")]))


def reaggregate(rollup: DataFrame, dims: Sequence[str], grains: Mapping[str, str], measures: Sequence[Measure]) -> DataFrame:
    """Answer a coarser query from a rollup."""
    plans = [stored(m) for m in measures]
    keys = [*dims, *[date_bucket(F.col(c), b).alias(c) for c, b in grains.items()]]
    parts = {c.alias: COMBINE[c.again](c.alias).alias(c.alias) for p in plans for c in p.components}
    unique = {p.measure.name: F.count_distinct(p.requires).alias(p.measure.name) for p in plans if p.requires}
    grouped = rollup.groupBy(*keys).agg(*parts.values(), *unique.values())
    names = [*dims, *grains]
    return grouped.select(*names, *[p.finish() if p.decomposable else F.col(p.measure.name) for p in plans])


def direct(df: DataFrame, dims: Sequence[str], grains: Mapping[str, str], measures: Sequence[Measure]) -> DataFrame:
    """The same query over base rows."""
    keys = [*dims, *[date_bucket(F.col(c), b).alias(c) for c, b in grains.items()]]
    return df.groupBy(*keys).agg(*[m.direct() for m in measures])


# The buckets that rows of a bucket can be grouped to. Weeks cross month ends: they make weeks alone.
MAKES = {b: {w for w in BUCKETS[i:] if b != "WEEKLY" or w == b} for i, b in enumerate(BUCKETS)}


def regroups(kept: str | None, asked: str | None) -> bool:
    """Rows kept by a bucket (None: the raw date) give the bucket that is asked for."""
    return kept is None or asked in MAKES[kept]


@dataclass(frozen=True)
class Rollup:
    """A stored rollup and what it holds."""

    name: str
    frame: DataFrame
    dims: tuple[str, ...]
    grains: Mapping[str, str | None]
    measures: tuple[str, ...]
    rows: int


@dataclass(frozen=True)
class Request:
    dims: tuple[str, ...]
    grains: Mapping[str, str]
    measures: tuple[Measure, ...]
    filters: Mapping[str, Column] = field(default_factory=dict)


def lacks(r: Rollup, q: Request) -> list[str]:
    """The columns, dates and measures of a request that a rollup cannot give; none if it can answer."""
    columns = {*q.dims, *q.filters, *(stored(m).requires for m in q.measures)} - {None}
    dates = {c for c, b in q.grains.items() if c not in r.grains or not regroups(r.grains[c], b)}
    return sorted(columns - {*r.dims} | dates | {m.name for m in q.measures} - {*r.measures})


def answer(q: Request, rollups: Sequence[Rollup], base: DataFrame) -> DataFrame:
    """From the smallest rollup that lacks nothing of the request, else from the base rows."""
    pick = next((r for r in sorted(rollups, key=lambda r: r.rows) if not lacks(r, q)), None)
    rows = base if pick is None else pick.frame
    for p in q.filters.values():
        rows = rows.filter(p)
    build = direct if pick is None else reaggregate
    return build(rows, q.dims, q.grains, q.measures)


def rollup_parity(rollup: DataFrame, base: DataFrame, dims: Sequence[str], measures: Sequence[Measure], tolerance: float = 1e-9) -> DataFrame:
    """Rollup and base totals per dims side by side, and whether all of them agree."""
    a = reaggregate(rollup, dims, {}, measures)
    b = direct(base, dims, {}, measures)
    named = lambda df, tag: df.select(*dims, *[F.col(m.name).cast("double").alias(f"{m.name}_{tag}") for m in measures])
    both = drill_across([named(a, "rollup"), named(b, "base")], dims)
    same = F.lit(True)
    for m in measures:
        x, y = F.col(f"{m.name}_rollup"), F.col(f"{m.name}_base")
        close = F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
        same = same & F.coalesce(close, x.isNull() & y.isNull())
    return both.withColumn("agrees", same)


def sketch_rollup(df: DataFrame, dims: Sequence[str], column: str, to: str = "sketch") -> DataFrame:
    """A mergeable distinct count as a stored component."""
    return df.groupBy(*dims).agg(F.hll_sketch_agg(column, 14).alias(to))


def sketch_count(rollup: DataFrame, dims: Sequence[str], to: str, sketch: str = "sketch") -> DataFrame:
    return rollup.groupBy(*dims).agg(F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias(to))


def profile_grains(df: DataFrame, grains: Mapping[str, Sequence[Column | str]], exact: bool = False) -> DataFrame:
    """Rows of each candidate grain beside the base rows, and the compression.

    One scan for all of them: with sketches by default; `exact` counts the groups of a lattice of grains. A base
    smaller than a grain marks the base as suspect.
    """
    if exact:
        out = grain_lattice(df, grains)
    else:
        one = df.agg(F.count("*").alias("base_rows"), *[F.approx_count_distinct(F.struct(*cols), 0.02).alias(f"g{i}") for i, cols in enumerate(grains.values())])
        rows = F.array(*[F.struct(F.lit(n).alias("grain"), F.col(f"g{i}").alias("agg_rows")) for i, n in enumerate(grains)])
        out = one.select("base_rows", F.inline(rows))
    return out.select(
        "grain", "agg_rows", "base_rows",
        F.round(F.try_divide(F.col("base_rows").cast("double"), F.col("agg_rows")), 1).alias("compression"),
        (F.col("base_rows") < F.col("agg_rows")).alias("suspect_base"),
    )


def grain_lattice(df: DataFrame, grains: Mapping[str, Sequence[Column | str]]) -> DataFrame:
    """The exact rows of each grain (grain, agg_rows, base_rows).

    The rows are grouped once, to all columns that any grain holds, and that table is written; each grain is then
    grouped from the narrowest wider grain at hand, which carries the number of base rows along. A grain
    that others come from is written too.
    """
    named: dict[str, str] = {}
    for cols in grains.values():
        for c in cols:
            named.setdefault(str(c), f"k{len(named)}")
    exprs = {str(c): (F.col(c) if isinstance(c, str) else c) for cols in grains.values() for c in cols}
    wanted = {n: frozenset(named[str(c)] for c in cols) for n, cols in grains.items()}
    every = frozenset(named.values())
    fine = df.select(*[exprs[e].alias(k) for e, k in named.items()]).groupBy(*sorted(every)).agg(F.count("*").alias("n"))
    at_hand = {every: settled(fine)}
    nearest = lambda g: min((h for h in at_hand if h >= g), key=lambda h: (len(h), sorted(h)))
    sets = sorted({*wanted.values()}, key=lambda g: (-len(g), sorted(g)))
    for i, g in enumerate(sets):
        if g not in at_hand:
            grouped = at_hand[nearest(g)].groupBy(*sorted(g)).agg(F.sum("n").alias("n"))
            at_hand[g] = settled(grouped) if any(h < g for h in sets[i + 1:]) else grouped
    sizes = [at_hand[g].agg(F.lit(n).alias("grain"), F.count("*").alias("agg_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("base_rows")) for n, g in wanted.items()]
    return reduce(DataFrame.unionByName, sizes)
