"""Semi-additive measures and time intelligence on grouped rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.functions.dates import date_bucket, end_of, period_index, start_of
from orrery.operators.keys import join_on

# --- semi-additive ---------------------------------------------------------------------------


def edge_value(df: DataFrame, groups: Sequence[str], date: str, value: str, to: str, last: bool = True) -> DataFrame:
    """The sum at the last (or first) date present in each group.

    Two grouped stages, both with partial aggregation; no row is gathered per group.
    """
    daily = df.filter(F.col(date).isNotNull()).groupBy(*groups, date).agg(F.sum(value).alias("_v"))
    pick = F.max_by if last else F.min_by
    return daily.groupBy(*groups).agg(pick("_v", date).alias(to))


def last_value_semi(df, groups, date, value, to) -> DataFrame:
    return edge_value(df, groups, date, value, to, last=True)


def first_value_semi(df, groups, date, value, to) -> DataFrame:
    return edge_value(df, groups, date, value, to, last=False)


def semi_beside(result: DataFrame, df: DataFrame, groups: Sequence[str], date: str, value: str, to: str, last: bool = True) -> DataFrame:
    """The edge value of another grouping beside each row of a grouped result."""
    return join_on(result, edge_value(df, groups, date, value, to, last), list(groups), "left")


def edge_value_in_period(
    df: DataFrame, groups: Sequence[str], date: str, unit: str, value: str, to: str, last: bool = True
) -> DataFrame:
    """Per group and period, the edge value if the period's own edge date is present, else NULL.

    Rows are (groups, period_start, value).
    """
    d = F.to_date(date)
    daily = df.filter(F.col(date).isNotNull()).groupBy(*groups, d.alias("_d")).agg(F.sum(value).alias("_v"))
    edge = end_of(unit, F.col("_d")) if last else start_of(unit, F.col("_d"))
    return daily.groupBy(*groups, start_of(unit, F.col("_d")).alias("period_start")).agg(
        F.max(F.when(F.col("_d") == edge, F.col("_v"))).alias(to)
    )


def semi_reaggregate(
    df: DataFrame, inner: Sequence[str], date: str, value: str, outer: Sequence[str], again, to: str
) -> DataFrame:
    """Aggregate the last values of a finer grouping, such as the greatest month-end balance."""
    return edge_value(df, inner, date, value, "_v").groupBy(*outer).agg(again("_v").alias(to))


def snapshot_period_end(df: DataFrame, entity: Sequence[str], date: str, bucket: str, value: str, to: str) -> DataFrame:
    """The last value of each entity in each period, as a table."""
    rows = df.withColumn("period_start", date_bucket(F.col(date), bucket))
    return edge_value(rows, [*entity, "period_start"], date, value, to)


# --- periods ----------------------------------------------------------------------------------


def bucketed(df: DataFrame, dims: Sequence[str], date: str, bucket: str, measures: Mapping[str, Column], to: str = "period_start") -> DataFrame:
    """Measures by dimensions and date bucket."""
    return df.groupBy(*dims, date_bucket(F.col(date), bucket).alias(to)).agg(*[m.alias(n) for n, m in measures.items()])


def period_offset(
    grouped: DataFrame, dims: Sequence[str], period: str, unit: str, measure: str, n: int, to: str, by: str | None = None
) -> DataFrame:
    """The measure n periods away (negative is earlier) beside each grouped row.

    A join on the period number, so a missing period gives NULL. `by` shifts in another
    unit than the rows have, such as monthly rows one year back.
    """
    steps = {("month", "year"): 12, ("month", "quarter"): 3, ("quarter", "year"): 4, ("day", "week"): 7}
    if by not in (None, unit) and (unit, by) not in steps:
        raise ValueError(f"a {by} is no fixed number of {unit}s")
    step = steps.get((unit, by), 1)
    other = grouped.select(
        *dims, (period_index(F.col(period), unit) - n * step).alias("_p"), F.col(measure).alias(to)
    )
    rows = grouped.withColumn("_p", period_index(F.col(period), unit))
    return join_on(rows, other, [*dims, "_p"], "left").drop("_p")


def growth(df: DataFrame, measure: str, prior: str) -> DataFrame:
    """Difference to the prior value, growth (difference over prior) and growth rate (over prior)."""
    return df.withColumn("difference", F.col(measure) - F.col(prior)).withColumn(
        "growth", F.try_divide(F.col(measure) - F.col(prior), F.col(prior))
    ).withColumn("growth_rate", F.try_divide(F.col(measure), F.col(prior)))


def reference_years(date: str, measure: str, ref: Column) -> dict[str, Column]:
    """This year's, last year's, the difference and its safe ratio, as aggregates."""
    total = lambda back: F.sum(
        F.when((F.col(date) >= start_of("year", ref, -back)) & (F.col(date) < start_of("year", ref, 1 - back)), F.col(measure))
    )
    this, prior = total(0), total(1)
    return {
        "this_year": this, "prior_year": prior, "yoy": this - prior,
        "yoy_pct": F.coalesce(F.try_divide(this - prior, prior), F.lit(0.0)),
    }


def to_date_measure(
    grouped: DataFrame, dims: Sequence[str], date: str, unit: str, measure: str, to: str, fn: str = "sum"
) -> DataFrame:
    """Period-to-date value on rows grouped by (dims, date)."""
    w = W.partitionBy(*dims, start_of(unit, F.col(date))).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return grouped.withColumn(to, {"sum": F.sum, "avg": F.avg}[fn](measure).over(w))


def point_in_time_count(
    df: DataFrame, dims: Sequence[str], start: str, end: str, first: str, last: str, to: str = "active"
) -> DataFrame:
    """Members with start <= day < end for each day from `first` to `last`; a NULL end is open.

    Members are counted by start day and by end day, and the calendar carries the
    running difference: no member is listed once per day it is active.
    """
    s, e = F.to_date(start), F.to_date(end)
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    valid = df.filter(s.isNotNull() & (e.isNull() | (s < e)))
    steps = valid.select(*dims, F.greatest(s, lo).alias("day"), F.lit(1).alias("_d")).filter(F.col("day") <= hi).unionByName(
        valid.filter(e.isNotNull()).select(*dims, F.greatest(e, lo).alias("day"), F.lit(-1).alias("_d")).filter(F.col("day") <= hi)
    )
    moves = steps.groupBy(*dims, "day").agg(F.sum("_d").alias("_d"))
    days = moves.select(*dims).distinct().withColumn("day", F.explode(F.sequence(lo, hi)))
    w = W.partitionBy(*dims).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return join_on(days, moves, [*dims, "day"], "left").select(
        *dims, "day", F.sum(F.coalesce(F.col("_d"), F.lit(0))).over(w).alias(to)
    )


def auto_bucket(df: DataFrame, date: str) -> DataFrame:
    """One row: the number of distinct dates and the default grain it suggests."""
    n = F.col("distinct_dates")
    return df.agg(F.count_distinct(F.to_date(date)).alias("distinct_dates")).withColumn(
        "bucket",
        F.when(n < 100, "YEARLY").when(n <= 1500, "MONTHLY").when(n <= 50000, "WEEKLY").otherwise("DAILY"),
    )


def densify_calendar(grouped: DataFrame, dims: Sequence[str], date: str, unit: str = "day") -> DataFrame:
    """A row for every period between the first and the last of each group; new rows have NULL measures."""
    span = grouped.groupBy(*dims).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = span.select(*dims, F.explode(F.expr(f"sequence(_a, _b, INTERVAL 1 {unit.upper()})")).alias(date))
    return join_on(days, grouped, [*dims, date], "left")
