"""Row filters from entitlements and variables, column rules and masks, secured rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, functions as F

from orrery.operators.joins import Dim, semi_join, star_join


@dataclass(frozen=True)
class User:
    """Who asks: name, groups, organisation, and variables set for organisation, user and model."""

    name: str
    groups: tuple[str, ...] = ()
    org: str = ""
    org_variables: Mapping[str, object] = field(default_factory=dict)
    user_variables: Mapping[str, object] = field(default_factory=dict)
    model_variables: Mapping[str, object] = field(default_factory=dict)

    def variable(self, name: str) -> list:
        """Values of a variable: those of the user or the model go before the organisation's."""
        for level in (self.user_variables, self.model_variables, self.org_variables):
            if name in level:
                v = level[name]
                return list(v) if isinstance(v, (list, tuple, set)) else [v]
        return []


def row_filter_groups(column: Column, user: User) -> Column:
    """The column holds one of the user's groups."""
    return F.coalesce(column.isin(list(user.groups)), F.lit(False)) if user.groups else F.lit(False)


def row_filter_user(column: Column, user: User) -> Column:
    return F.coalesce(column == user.name, F.lit(False))


def row_filter_entitled(df: DataFrame, column: str, entitlements: DataFrame, user: User, holder: str, value: str) -> DataFrame:
    """Rows whose column is entitled to the user or one of the user's groups by a table."""
    mine = entitlements.filter(F.col(holder).isin([user.name, *user.groups]))
    return semi_join(df, mine, [(column, value)])


def row_filter_variable(column: Column, user: User, variable: str) -> Column:
    """The column equals one of the variable's values; without values nothing passes."""
    values = user.variable(variable)
    return F.coalesce(column.isin(values), F.lit(False)) if values else F.lit(False)


def row_filter_or_admin(predicate: Column, user: User, admins: Sequence[str]) -> Column:
    """Members of an admin group see everything."""
    return F.lit(bool(set(user.groups) & set(admins))) | predicate


def row_filter_joined(df: DataFrame, dims: Sequence[Dim], column: str, predicate) -> DataFrame:
    """Filter by a column of joined tables; if it is not there, no row passes."""
    joined = star_join(df, *dims)
    if column not in joined.columns:
        return df.filter(F.lit(False))
    return joined.filter(F.coalesce(predicate(F.col(column)), F.lit(False))).select(*[joined[c] for c in df.columns])


@dataclass(frozen=True)
class ColumnRule:
    """Restricts a column: members of `group` read it, where several rules name the column members of any of
    their groups; '' as group means nobody. '' as organisation or table means every one."""

    column: str
    group: str
    table: str = ""
    org: str = ""


def rules_of(rows: Sequence[Mapping | Row]) -> list[ColumnRule]:
    """Rules from a manifest of (org_name, table_name, column_name, group_name), repeated rows once. A row without
    a column or a table is refused, since no one could tell what it closes; a missing group closes to everybody."""
    out: dict[ColumnRule, None] = {}
    for row in rows:
        named = {k.strip().lower(): (v or "").strip() for k, v in (row.asDict() if isinstance(row, Row) else row).items()}
        rule = ColumnRule(named.get("column_name", ""), named.get("group_name", ""), named.get("table_name", ""), named.get("org_name", ""))
        if not rule.column or not rule.table:
            raise ValueError(f"a column rule must name its table and column: {named}")
        out[rule] = None
    return list(out)


def closed_columns(columns: Sequence[str], rules: Sequence[ColumnRule], user: User, table: str = "") -> list[str]:
    """The columns of a table that the user may not read. Names are compared as Spark does, without regard to case."""
    groups: dict[str, set[str]] = {}
    for r in rules:
        if r.org in ("", user.org) and r.table.lower() in ("", table.lower()):
            groups.setdefault(r.column.lower(), set()).update({r.group} - {""})
    return [c for c in columns if c.lower() in groups and not groups[c.lower()] & set(user.groups)]


def allowed_columns(columns: Sequence[str], rules: Sequence[tuple[str, str]], groups: Sequence[str]) -> list[str]:
    """Columns a user may read by rules (column, group); '' as group means nobody. Others are open."""
    closed = closed_columns(columns, [ColumnRule(*r) for r in rules], User("", tuple(groups)))
    return [c for c in columns if c not in closed]


def column_rules(df: DataFrame, rules: Sequence[ColumnRule | tuple[str, str]], user: User, mask: bool = False, table: str = "") -> DataFrame:
    """Drop the columns of `table` that the user may not read, or keep them as NULL.

    A rule on this table that names no column of it is refused: a column it was meant for may be open under another name.
    """
    rules = [r if isinstance(r, ColumnRule) else ColumnRule(*r) for r in rules]
    known = {c.lower() for c in df.columns}
    lost = sorted({r.column for r in rules if r.table and r.table.lower() == table.lower() and r.column.lower() not in known})
    if lost:
        raise ValueError(f"{table} has no columns {lost}, which rules restrict")
    closed = set(closed_columns(df.columns, rules, user, table))
    if not mask:
        return df.select(*[c for c in df.columns if c not in closed])
    return df.select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) if c in closed else F.col(c) for c in df.columns])


def mask_column(c: Column, how: str) -> Column:
    """hash: SHA-256; last4: stars but the last four characters (all stars for four or fewer); digits: every digit as '#'."""
    s = c.cast("string")
    if how == "hash":
        return F.sha2(s, 256)
    if how == "last4":
        hidden = F.when(F.length(s) > 4, F.length(s) - 4).otherwise(F.length(s))
        return F.concat(F.repeat(F.lit("*"), hidden), F.when(F.length(s) > 4, F.right(s, F.lit(4))).otherwise(F.left(s, F.lit(0))))
    if how == "digits":
        return F.regexp_replace(s, "[0-9]", "#")
    raise ValueError(f"unknown mask {how}")


def secured_dims(dims: Sequence[str], filter_columns: Sequence[str], available: Sequence[str]) -> list[str]:
    """The grain of a rollup with the columns its row filters need added; refused if one does not exist."""
    lost = [c for c in filter_columns if c not in available]
    if lost:
        raise ValueError(f"row filters need {lost}, which the source lacks: the rollup cannot be secured")
    return [*dims, *[c for c in filter_columns if c not in dims]]
