"""Bins, tiers, named groups, cohorts by rank or condition, funnels, top-k and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.operators.joins import map_lookup

# --- bins and groups ------------------------------------------------------------------------


def bin_fixed(x: Column, low: float, high: float, size: float) -> Column:
    """Number of the bin of x in [low, high), from 0; NULL outside."""
    return F.when((x >= low) & (x < high), F.floor((x - low) / F.lit(size)))


def bin_dynamic(x: Column, size) -> Column:
    """Lower edge of the bin of x; `size` is usually a parameter."""
    return F.floor(x / size) * size


def tier(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the tier: below the first edge, between edges, from the last edge up."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    out = F.when(x < edges[0], labels[0])
    for e, label in zip(edges[1:], labels[1:]):
        out = out.when(x < e, label)
    return out.when(x >= edges[-1], labels[-1])


@dataclass(frozen=True)
class Group:
    """A named group: conditions (column, operator, values) joined by ALL or ANY."""

    name: str
    conditions: Sequence[tuple[str, str, Sequence]]
    combine: str = "ALL"

    def predicate(self) -> Column:
        tests = {
            "EQ": lambda c, v: c == v[0], "NE": lambda c, v: c != v[0],
            "GT": lambda c, v: c > v[0], "GE": lambda c, v: c >= v[0],
            "LT": lambda c, v: c < v[0], "LE": lambda c, v: c <= v[0],
            "BW": lambda c, v: c.between(v[0], v[1]),
            "IN": lambda c, v: c.isin(list(v)), "NOT_IN": lambda c, v: ~c.isin(list(v)),
        }
        parts = [tests[op](F.col(c), v) for c, op, v in self.conditions]
        return reduce(and_ if self.combine == "ALL" else or_, parts)


def group_based(groups: Sequence[Group], otherwise: Column | str | None = None) -> Column:
    """Name of the first group that fits; else the label, or NULL."""
    out = reduce(lambda acc, g: acc.when(g.predicate(), g.name), groups[1:], F.when(groups[0].predicate(), groups[0].name))
    return out if otherwise is None else out.otherwise(otherwise)


def manual_group_map(df: DataFrame, column: str, groups: Mapping[str, Sequence], to: str, default: str) -> DataFrame:
    """Explicit value to group, by a small mapping table."""
    pairs = [(v, g) for g, values in groups.items() for v in values]
    mapping = df.sparkSession.createDataFrame(pairs, f"v {dict(df.dtypes)[column]}, g string")
    return map_lookup(df, column, mapping, to, default)


def value_alias(df: DataFrame, column: str, aliases: Mapping, to: str) -> DataFrame:
    """Display value of a stored value, itself where it has none."""
    mapping = df.sparkSession.createDataFrame(list(aliases.items()), f"v {dict(df.dtypes)[column]}, a string")
    return map_lookup(df, column, mapping, "_alias").withColumn(
        to, F.coalesce(F.col("_alias"), F.col(column).cast("string"))
    ).drop("_alias")


def set_static(c: Column, members: Sequence, exclude: bool = False) -> Column:
    """In the list of members, where None stands for NULL; `exclude` turns it around. Never NULL."""
    listed = [m for m in members if m is not None]
    inside = F.coalesce(c.isin(listed), F.lit(False)) if listed else F.lit(False)
    if None in members:
        inside = inside | c.isNull()
    return ~inside if exclude else inside


# --- cohorts --------------------------------------------------------------------------------


def ranked_members(df: DataFrame, member: str, measure: Column, n: int, top: bool = True) -> DataFrame:
    """Members whose rank by the measure is at most n (ties included), as one column.

    The nth best total is found with a top-n sort of the grouped rows and the members at
    or beyond it are kept, so nothing is ranked in one task.
    """
    totals = df.groupBy(member).agg(measure.alias("_m")).filter(F.col("_m").isNotNull())
    by = F.col("_m").desc() if top else F.col("_m").asc()
    best = totals.select("_m").orderBy(by).limit(n)
    edge = best.agg((F.min if top else F.max)("_m")).scalar()
    return totals.filter(F.col("_m") >= edge if top else F.col("_m") <= edge).select(member)


def condition_members(df: DataFrame, member: str, measures: Mapping[str, Column], condition: Column) -> DataFrame:
    """Members whose aggregates meet the condition."""
    return df.groupBy(member).agg(*[m.alias(n) for n, m in measures.items()]).filter(condition).select(member)


def keep_members(df: DataFrame, member: str, members: DataFrame) -> DataFrame:
    return df.join(members.select(F.col(member).alias("_m")), F.col(member) == F.col("_m"), "left_semi")


def drop_members(df: DataFrame, member: str, members: DataFrame) -> DataFrame:
    return df.join(members.select(F.col(member).alias("_m")), F.col(member) == F.col("_m"), "left_anti")


def in_set(df: DataFrame, member: str, members: DataFrame, to: str) -> DataFrame:
    """A boolean column: is the member in the set? Sets can then be mixed with &, | and ~."""
    key = f"_{to}"
    once = members.select(F.col(member).alias(key)).distinct()
    return df.join(once, F.col(member) == F.col(key), "left").withColumn(to, F.col(key).isNotNull()).drop(key)


def topn_with_others(df: DataFrame, member: str, measure: str, n: int, others: str = "Others") -> DataFrame:
    """Totals of the top n members, and one row for all the rest, told from a member of its name by `is_rest`."""
    top = ranked_members(df, member, F.sum(measure), n)
    flagged = in_set(df, member, top, "_in")
    name = F.when(F.col("_in"), F.col(member).cast("string")).otherwise(others)
    return flagged.groupBy(name.alias(member), (~F.col("_in")).alias("is_rest")).agg(F.sum(measure).alias(measure))


def set_query(
    df: DataFrame, member: str, measure: Column, n: int, filters: Mapping[str, Column],
    accept_all: bool = False, include: Sequence[str] = (), exclude: Sequence[str] = (),
) -> DataFrame:
    """Top n members where only the passed-through outer filters reach the ranking."""
    passed = [
        p for c, p in filters.items()
        if c not in exclude and (accept_all or c in include or (exclude and not include))
    ]
    return ranked_members(reduce(DataFrame.filter, passed, df), member, measure, n)


def event_funnel(df: DataFrame, session: Sequence[str], ts: str, event: str, steps: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Sessions that reached step 1, steps 1 to 2 in time order, and so on."""
    firsts = df.groupBy(*groups, *session).agg(
        *[F.min(F.when(F.col(event) == s, F.col(ts))).alias(f"_t{i}") for i, s in enumerate(steps)]
    )
    reached, out = F.col("_t0").isNotNull(), []
    for i, s in enumerate(steps):
        if i:
            reached = reached & (F.col(f"_t{i - 1}") < F.col(f"_t{i}"))
        out.append(F.count(F.when(reached, 1)).alias(f"step_{i + 1}"))
    return firsts.groupBy(*groups).agg(*out)


# --- order, top-k, set operations -----------------------------------------------------------


def order_by(df: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """Sort by (column, 'asc' | 'desc') with NULLs last."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in keys])


def custom_position(c: Column, values: Sequence) -> Column:
    """Place of a value in a declared order, from 1; unlisted values come after."""
    out = F.lit(len(values) + 1)
    for i, v in reversed(list(enumerate(values, 1))):
        out = F.when(c == v, i).otherwise(out)
    return out


def top_k(df: DataFrame, k: int, *keys: tuple[str, str]) -> DataFrame:
    """The first k rows of an order; each task keeps only its own k."""
    return order_by(df, *keys).limit(k)


def topn_per_group(df: DataFrame, groups: Sequence[str], n: int, *keys: tuple[str, str], ties: bool = False, to: str = "rank") -> DataFrame:
    """Rows ranked at most n in their group, with shared ranks (`ties`) or strict ones.

    Spark limits each group in every task before the shuffle.
    """
    by = [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in keys]
    w = W.partitionBy(*groups).orderBy(*by)
    return df.withColumn(to, (F.rank() if ties else F.row_number()).over(w)).filter(F.col(to) <= n)


def qualify(df: DataFrame, window_value: Column, condition) -> DataFrame:
    """Filter on a window value that is not kept."""
    return df.withColumn("_q", window_value).filter(condition(F.col("_q"))).drop("_q")


def union_typed(*frames: DataFrame) -> DataFrame:
    """Stack by position after checking that names count and types agree."""
    first = frames[0]
    for f in frames[1:]:
        if len(f.columns) != len(first.columns):
            raise ValueError(f"{len(f.columns)} columns beside {len(first.columns)}")
        for a, b in zip(first.schema, f.schema):
            if a.dataType != b.dataType:
                raise ValueError(f"{b.name}: {b.dataType.simpleString()} beside {a.name}: {a.dataType.simpleString()}")
    return reduce(DataFrame.union, frames)
