"""A star-schema model: tables, joins, attributes, measures, formulas, filters, row rules.

`Model.query` builds one lazy DataFrame. Everything here is metadata work; the frames
do the rest. Expressions are SQL texts over column names, which are unique across
tables (give a table a `prefix` where they are not).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.dates import date_bucket
from orrery.operators import rollups as P
from orrery.operators.filters import Filter, Parameter, rolling_date_constraint
from orrery.operators.joins import Dim, drill_across, star_join
from orrery.operators.security import ColumnRule, User, closed_columns
from orrery.operators.timeintel import edge_value
from orrery.plans.stages import Question, Stage


@dataclass(frozen=True)
class Table:
    name: str
    frame: DataFrame
    prefix: str = ""


@dataclass(frozen=True)
class Join:
    """From the many side to the one side; `how` is inner, left, right or full."""

    many: str
    one: str
    on: Sequence[tuple[str, str]]
    how: str = "inner"


@dataclass(frozen=True)
class Attribute:
    name: str
    table: str
    expr: str
    bucket: str | None = None


@dataclass(frozen=True)
class Formula:
    """A row-level formula on the tables it names; `uses` lists other formulas it refers to."""

    name: str
    tables: tuple[str, ...]
    expr: str
    uses: tuple[str, ...] = ()


@dataclass(frozen=True)
class Measure:
    """An aggregate SQL text over one fact and what hangs on it.

    With `last_by` (a date column), `expr` is a value that is summed at the last date
    present in each group; `first_by` takes the first date. `parts` declares the same measure by kind over a column
    or formula (its name is not used), so that a stored rollup can keep it.
    """

    name: str
    fact: str
    expr: str
    uses: tuple[str, ...] = ()
    last_by: str | None = None
    first_by: str | None = None
    parts: P.Measure | None = None
    digits: int | None = None


@dataclass(frozen=True)
class RowRule:
    """A row filter on a table: given the user, a predicate over its columns. A rollup can be read under a rule only
    where `columns` names all that the predicate reads, and the rollup holds them."""

    table: str
    predicate: Callable[[User], Column]
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Stored:
    """A rollup of one fact's measures that a model made (`Model.rollup`)."""

    fact: str
    kept: P.Rollup


@dataclass(frozen=True)
class Model:
    tables: Sequence[Table]
    joins: Sequence[Join]
    attributes: Sequence[Attribute]
    measures: Sequence[Measure]
    formulas: Sequence[Formula] = ()
    parameters: Sequence[Parameter] = ()
    filters: Sequence[Filter] = ()
    constraints: Mapping[str, Sequence[Sequence[tuple[str, int, str]]]] = field(default_factory=dict)
    row_rules: Sequence[RowRule] = ()
    column_rules: Sequence[ColumnRule | tuple[str, str]] = ()
    formula_depth: int = 3
    # Tables that the way to a table must lead through, where several lead there.
    via: Mapping[str, Sequence[str]] = field(default_factory=dict)

    # -- metadata ------------------------------------------------------------------------

    def _one(self, kind: str, name: str):
        found = [x for x in getattr(self, kind) if x.name == name]
        if len(found) != 1:
            raise ValueError(f"{len(found)} {kind} are called {name}")
        return found[0]

    def _owners(self, column: str) -> set[str]:
        """The tables that a column or a formula is made of."""
        found = [t.name for t in self.tables if column in {t.prefix + c for c in t.frame.columns}]
        if found:
            return {found[0]}
        return {t for f in self._formulas([column]) for t in f.tables}

    def _formulas(self, names: Sequence[str]) -> list[Formula]:
        """The named formulas and those they refer to, each after what it needs; at most `formula_depth` deep."""
        done: list[Formula] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise ValueError(f"formulas refer to each other in a circle: {' > '.join([*path, name])}")
            if len(path) >= self.formula_depth:
                raise ValueError(f"formulas nest deeper than {self.formula_depth}: {' > '.join([*path, name])}")
            f = self._one("formulas", name)
            for u in f.uses:
                visit(u, (*path, name))
            if f not in done:
                done.append(f)

        for n in names:
            visit(n, ())
        return done

    def _ways(self, start: str) -> dict[str, list[list[Join]]]:
        """All ways of many-to-one joins from a table to each table it reaches."""
        ways: dict[str, list[list[Join]]] = {start: [[]]}

        def walk(at: str, path: list[Join]) -> None:
            for j in self.joins:
                if j.many == at and j.one != start and j.one not in {x.one for x in path}:
                    ways.setdefault(j.one, []).append([*path, j])
                    walk(j.one, [*path, j])

        walk(start, [])
        return ways

    def _reach(self, start: str) -> dict[str, list[Join]]:
        """Tables reachable from a table by many-to-one joins, each with the joins that lead there.

        Where two ways lead to a table, the question must say which it means: `via` names tables on the way.
        Without that, the table and those behind it are refused (`joins_for`), not the model.
        """
        paths: dict[str, list[Join]] = {}
        for table, ways in self._ways(start).items():
            kept = ways
            for on_way, stops in self.via.items():
                # What is named for a table also holds for the tables behind it.
                kept = [w for w in kept if on_way not in {j.one for j in w} or {*stops} <= {start, *(j.one for j in w[:[j.one for j in w].index(on_way) + 1])}]
            if len(kept) == 1:
                paths[table] = kept[0]
            elif not kept:
                raise ValueError(f"no way from {start} to {table} leads through {[*self.via.get(table, ())]}")
        return paths

    def _reads(self, expr: str, names: Sequence[str]) -> set[str]:
        """The columns and formulas of a SQL text, and what those formulas are made of, in lower case.

        Names in backquotes must be columns or formulas; one that is neither cannot be resolved, and the
        question is refused.
        """
        quoted = {w.lower() for w in re.findall(r"`([^`]*)`", expr)}
        known = {(t.prefix + c).lower() for t in self.tables for c in t.frame.columns} | {f.name.lower() for f in self.formulas}
        if quoted - known:
            raise PermissionError(f"{sorted(quoted - known)} cannot be resolved, so that nobody may read them")
        words = {w.lower() for w in re.findall(r"\w+", expr)} | quoted | {n.lower() for n in names}
        out = set(words)
        for f in self.formulas:
            if f.name.lower() in words:
                out |= {f.name.lower()} | self._reads(f.expr, [*f.uses])
        return out

    def _closed(self, user: User) -> set[str]:
        """Everything the user may not read, in lower case: columns under their names in the model, and formulas,
        attributes or measures that a rule names without a table. A rule must name something of the model."""
        rules = [r if isinstance(r, ColumnRule) else ColumnRule(*r) for r in self.column_rules]
        names = {x.name for kind in (self.formulas, self.attributes, self.measures) for x in kind}
        everywhere = names | {t.prefix + c for t in self.tables for c in t.frame.columns}
        for r in rules:
            held = [t for t in self.tables if t.name.lower() == r.table.lower()]
            of = {c.lower() for t in held for c in t.frame.columns} if r.table else {n.lower() for n in everywhere}
            if r.column.lower() not in of:
                raise ValueError(f"a column rule names {r.table + '.' if r.table else ''}{r.column}, which the model does not have")
        free = [r for r in rules if not r.table]
        closed = {c.lower() for c in closed_columns(sorted(everywhere), free, user)}
        for t in self.tables:
            mine = [ColumnRule(r.column, r.group, r.table, r.org) for r in rules if r.table]
            closed |= {(t.prefix + c).lower() for c in closed_columns(t.frame.columns, mine, user, t.name)}
        return closed

    def _check_columns(self, user: User, attributes, measures, filters, having: str | None) -> None:
        """Refuse a question that shows, groups or filters by anything the user may not read."""
        closed = self._closed(user)
        texts = {a.name: (a.expr, ()) for a in attributes} | {m.name: (m.expr, m.uses) for m in measures}
        texts |= {f"filter {i + 1}": (p, fs) for i, (_, fs, p) in enumerate(filters)}
        texts |= {f"dates of {m.name}": (f"{m.last_by or ''} {m.first_by or ''}", ()) for m in measures}
        if having is not None:
            texts["having"] = (having, ())
        for name, (expr, uses) in texts.items():
            read = sorted(({name.lower()} | self._reads(expr, uses)) & closed)
            if read:
                raise PermissionError(f"{name} reads {read}, which {user.name} may not")

    def joins_for(self, start: str, needed: set[str]) -> list[Join]:
        """Joins to make from a fact: those that lead to needed tables, and every other that changes rows.

        An inner join drops unmatched rows and right and full joins add some, so they stay
        though nothing of theirs is asked for. A left join to the one side changes nothing
        and is left out unless needed.
        """
        paths = self._reach(start)
        ways = self._ways(start)
        # An inner, right or full join changes rows, so its table must not be left out just because its way is open.
        open_ = {t for t, w in ways.items() if t not in paths and (t in needed or any(p[-1].how != "left" for p in w))}
        if open_:
            raise ValueError(f"more than one way leads from {start} to {sorted(open_)}: name a table on the way with via")
        lost = needed - set(paths)
        if lost:
            raise ValueError(f"{sorted(lost)} cannot be reached from {start} without multiplying its rows")
        used: list[Join] = []
        for table, path in paths.items():
            if table in needed or (path and path[-1].how != "left"):
                used += [j for j in path if j not in used]
        return [j for p in sorted(paths.values(), key=len) for j in p[-1:] if j in used]

    # -- frames --------------------------------------------------------------------------

    def _rows(self, start: str, needed: set[str], formulas: Sequence[Formula], user: User | None, ref: Column | None) -> DataFrame:
        """Filtered, joined rows of one fact with its row-level formulas."""
        paths = self._reach(start)
        # A row rule on a reachable table always applies, so its table is always joined; so
        # is the table of every filter that applies.
        if user is not None:
            needed = needed | {r.table for r in self.row_rules if r.table in paths}
        scope = {start, *(j.one for j in self.joins_for(start, needed))}
        active = [f for f in self.filters if f.applies(scope) and self._owners(f.column) <= set(paths)]
        needed = needed | {t for f in active for t in self._owners(f.column)}
        backing = [f.column for f in active if any(x.name == f.column for x in self.formulas)]
        formulas = list(dict.fromkeys([*formulas, *self._formulas(backing)]))
        needed = needed | {t for f in formulas for t in f.tables}
        path = self.joins_for(start, needed)
        used = {start, *(j.one for j in path)}

        def prepared(name: str) -> DataFrame:
            t = self._one("tables", name)
            df = t.frame.select(*[F.col(c).alias(t.prefix + c) for c in t.frame.columns]) if t.prefix else t.frame
            if name in self.constraints:
                if ref is None:
                    raise ValueError(f"{name} has a date constraint: give the reference date")
                df = df.filter(rolling_date_constraint(self.constraints[name], ref))
            return df

        rows = star_join(prepared(start), *[Dim(prepared(j.one), j.on, j.how) for j in path])
        for f in formulas:
            rows = rows.withColumn(f.name, F.expr(f.expr))
        for flt in active:
            rows = rows.filter(flt.predicate())
        if user is not None:
            for rule in self.row_rules:
                if rule.table in used:
                    rows = rows.filter(F.coalesce(rule.predicate(user), F.lit(False)))
        return rows

    def query(
        self,
        attributes: Sequence[str] = (),
        measures: Sequence[str] = (),
        filters: Sequence[tuple[Sequence[str], Sequence[str], str]] = (),
        parameters: Mapping[str, object] | None = None,
        user: User | None = None,
        having: str | None = None,
        ref: Column | None = None,
        unsecured: bool = False,
        stages: Sequence[Stage] = (),
        via: Mapping[str, Sequence[str]] | None = None,
        rollups: Sequence[Stored] = (),
    ) -> DataFrame:
        """Attributes and measures, grouped.

        A filter is (tables it reads, formulas it uses, SQL predicate). `{name}` in a
        predicate stands for the column `_p_name`, which holds a parameter's value. A filter
        on tables of one fact alone filters that fact; another fact, which cannot reach
        them, keeps its rows. Where the model has rules, a question needs a user;
        `unsecured` says that it is meant to be asked without.

        `stages` add levels of detail, windows and sets. `via` names, for a table that several ways lead to,
        tables on the way that is meant. A question of one fact that a rollup among `rollups` can answer in full,
        filters and row rules included, is answered from the smallest such one.
        """
        if via is not None:
            return replace(self, via=via).query(attributes, measures, filters, parameters, user, having, ref, unsecured, stages, None, rollups)
        if stages:
            ask = lambda atts, mes, fs: self.query(atts, mes, filters if fs is None else fs, parameters, user, None, ref, unsecured, (), None, rollups)
            out, q = ask(attributes, measures, None), Question(tuple(attributes), tuple(filters), ask)
            for stage in stages:
                out = stage.apply(out, q)
            return out if having is None else out.filter(having)
        atts = [self._one("attributes", a) for a in attributes]
        mes = [self._one("measures", m) for m in measures]
        if user is None and not unsecured and (self.row_rules or self.column_rules):
            raise PermissionError("the model has rules: name the user, or ask unsecured")
        if user is not None:
            self._check_columns(user, atts, mes, filters, having)
        facts = list(dict.fromkeys(m.fact for m in mes))
        if rollups and len(facts) == 1:
            answered = self._from_rollup(atts, mes, filters, parameters, user, rollups)
            if answered is not None:
                return answered if having is None else answered.filter(having)

        def needs(flt) -> set[str]:
            return set(flt[0]) | {t for f in self._formulas(list(flt[1])) for t in f.tables}

        for flt in filters:
            if facts and not any(needs(flt) <= set(self._reach(fact)) for fact in facts):
                raise ValueError(f"no fact of the question reaches {sorted(needs(flt))} of the filter {flt[2]}")

        def grouped_rows(start: str, uses: Sequence[str]) -> DataFrame:
            """Rows of one fact with the formulas and filters that are its own."""
            mine = [f for f in filters if needs(f) <= set(self._reach(start))]
            formulas = self._formulas([*uses, *(u for f in mine for u in f[1])])
            tables = {a.table for a in atts} | {t for f in mine for t in f[0]} | {t for f in formulas for t in f.tables}
            rows = self._rows(start, tables, formulas, user, ref)
            for p in self.parameters:
                rows = rows.withColumn(f"_p_{p.name}", p.value((parameters or {}).get(p.name)))
            for _, _, predicate in mine:
                rows = rows.filter(F.expr(predicate.format(**{p.name: f"_p_{p.name}" for p in self.parameters})))
            for a in atts:
                v = F.expr(a.expr)
                rows = rows.withColumn(a.name, v if a.bucket is None else date_bucket(v, a.bucket))
            return rows

        if not mes:
            # No measure: only the dimension's own rows are read.
            base_tables = {a.table for a in atts} | {t for f in filters for t in needs(f)}
            start = next((a.table for a in atts if base_tables <= set(self._reach(a.table))), None)
            if start is None:
                raise ValueError("attributes of unrelated tables need a measure to relate them")
            return grouped_rows(start, ()).select(*attributes).distinct()

        parts = []
        for fact in facts:
            mine = [m for m in mes if m.fact == fact]
            rows = grouped_rows(fact, [u for m in mine for u in m.uses])
            plain = [m for m in mine if not (m.last_by or m.first_by)]
            if plain:
                parts.append(rows.groupBy(*attributes).agg(*[F.expr(m.expr).alias(m.name) for m in plain]))
            for m in (m for m in mine if m.last_by or m.first_by):
                valued = rows.withColumn("_value", F.expr(m.expr))
                parts.append(edge_value(valued, attributes, m.last_by or m.first_by, "_value", m.name, last=bool(m.last_by)))
        out = parts[0] if len(parts) == 1 else drill_across(parts, list(attributes))
        out = out.select(*attributes, *measures)
        return out if having is None else out.filter(having)

    # -- rollups -------------------------------------------------------------------------

    def _date(self, a: Attribute) -> str | None:
        """The date column behind a bucketed attribute."""
        return a.expr if a.bucket is not None and re.fullmatch(r"\w+", a.expr) else None

    def rollup(self, name: str, attributes: Sequence[str], measures: Sequence[str]) -> Stored:
        """The rows of one fact grouped to the attributes, with the parts of declared measures.

        The model's own filters are in it, its rules are not: they apply when it is read. The columns that row
        rules read are added to the attributes, and a rule that does not name its columns, or names one that no
        attribute holds, refuses the rollup; so do date constraints, which change with the day. The frame is lazy:
        write it and put the stored one in its place.
        """
        atts, mes = [self._one("attributes", a) for a in attributes], [self._one("measures", m) for m in measures]
        facts = {m.fact for m in mes}
        if len(facts) != 1 or any(m.parts is None for m in mes):
            raise ValueError("a rollup keeps declared measures of one fact")
        if self.constraints:
            raise ValueError("rows under a date constraint change with the day: they cannot be kept")
        fact = facts.pop()
        for rule in self.row_rules:
            if rule.table in self._reach(fact):
                if rule.columns is None:
                    raise ValueError(f"a row rule on {rule.table} does not say which columns it reads: the rollup could not be secured")
                for c in rule.columns:
                    held = next((a for a in self.attributes if a.expr == c and a.bucket is None and a.table == rule.table), None)
                    if held is None:
                        raise ValueError(f"no attribute holds {c}, which a row rule on {rule.table} reads: the rollup could not be secured")
                    if held not in atts:
                        atts.append(held)
        dims = [a for a in atts if a.bucket is None]
        grains = {self._date(a): a.bucket for a in atts if a.bucket is not None}
        if None in grains or len(grains) < len([a for a in atts if a.bucket is not None]):
            raise ValueError("a rollup keeps one bucket of each date column")
        formulas = self._formulas([u for m in mes for u in m.uses])
        rows = self._rows(fact, {a.table for a in atts} | {t for f in formulas for t in f.tables}, formulas, None, None)
        for a in dims:
            rows = rows.withColumn(a.name, F.expr(a.expr))
        frame = P.build_rollup(rows, [a.name for a in dims], grains, [replace(m.parts, name=m.name) for m in mes])
        return Stored(fact, P.Rollup(name, frame, tuple(a.name for a in dims), grains, tuple(m.name for m in mes), 0))

    def _from_rollup(self, atts, mes, filters, parameters, user: User | None, rollups: Sequence[Stored]) -> DataFrame | None:
        """The answer from the smallest rollup that has all it takes, or None."""
        if any(m.parts is None for m in mes) or self.via:
            return None
        dated = [a for a in atts if a.bucket is not None]
        grains = {self._date(a): a.bucket for a in dated}
        if None in grains or len(grains) < len(dated):
            return None
        by_column = {a.expr: a.name for a in self.attributes if a.bucket is None and re.fullmatch(r"\w+", a.expr)}
        rules = [r for r in self.row_rules if user is not None and r.table in self._reach(mes[0].fact)]
        if any(r.columns is None for r in rules) or any(fs for _, fs, _ in filters):
            return None
        # Every column of the fact's tables that a filter reads must be an attribute of the rollup.
        every = {t.prefix + c for t in self.tables for c in t.frame.columns}
        read = {c for _, _, text in filters for c in re.findall(r"\w+", text) if c in every} | {c for r in rules for c in r.columns}
        if not read <= set(by_column):
            return None
        measures = tuple(replace(m.parts, name=m.name) for m in mes)
        q = P.Request(tuple(a.name for a in atts if a.bucket is None), grains, measures, {by_column[c]: F.lit(True) for c in read})
        able = [s.kept for s in rollups if s.fact == mes[0].fact and not P.lacks(s.kept, q)]
        if not able:
            return None
        rows = min(able, key=lambda r: r.rows).frame
        for c in sorted(read):
            rows = rows.withColumn(c, F.col(by_column[c]))
        for p in self.parameters:
            rows = rows.withColumn(f"_p_{p.name}", p.value((parameters or {}).get(p.name)))
        for _, _, text in filters:
            rows = rows.filter(F.expr(text.format(**{p.name: f"_p_{p.name}" for p in self.parameters})))
        for r in rules:
            rows = rows.filter(F.coalesce(r.predicate(user), F.lit(False)))
        out = P.reaggregate(rows, q.dims, grains, measures)
        named = [F.col(a.name) if a.bucket is None else F.col(self._date(a)).alias(a.name) for a in atts]
        return out.select(*named, *[(F.col(m.name) if m.digits is None else F.round(m.name, m.digits)).alias(m.name) for m in mes])
