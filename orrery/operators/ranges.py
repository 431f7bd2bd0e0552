"""Joins of points with intervals.

Interval levels: an interval is listed at the level of its own length, whose bins are wide enough that it
touches two of them at most; a row looks into its one bin at each level that occurs. So a day and a century
in one table cost two listings each, and neither side is read to learn the other's span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orrery.operators.keys import equal_pairs, share_of

# Bins of level k are 4**k seconds wide. Open intervals have a level of their own, with a bin on each side of 1970.
OPEN, FAR = 31, 1 << 61
# Without keys, rows and intervals meet in one of so many shares of each bin, fewer if the intervals would then be
# listed more often than that.
SALTS, LISTINGS = 32, 1 << 20
# Equal rows are written out in arrays of at most this length.
COPIES = 1 << 14


def position(c: Column) -> Column:
    """Seconds since 1970 for dates and timestamps."""
    return F.unix_seconds(c.cast("timestamp"))


def _level(first: Column, last: Column) -> Column:
    """The least k with 4**k of at least the seconds from first to last, both counted."""
    bits = F.length(F.bin(last - first))  # 2**bits is more than the difference
    return F.when(last == first, 0).otherwise(F.floor((bits + 1) / 2)).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level * 2)


def _repeated(df: DataFrame, n: Column, columns: Sequence[Column]) -> DataFrame:
    """`columns` of each row n times, through arrays of bounded length."""
    chunks = df.withColumn("_copies", n).withColumn("_at", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES))))
    size = F.least(F.lit(COPIES), F.col("_copies") - F.col("_at") * COPIES).cast("int")
    return chunks.withColumn("_one", F.explode(F.array_repeat(F.lit(True), size))).select(*columns)


def join_range(
    left: DataFrame, right: DataFrame, ts: str, start: str, end: str, keys: Sequence[tuple[str, str]] = (), how: str = "left",
) -> DataFrame:
    """Rows of `right` whose half-open interval [start, end) holds `left.ts`.

    A NULL start or end is open; an interval that ends where it starts, or before, holds nothing; a NULL `ts` is
    in no interval. Both sides meet on keys, level and bin, so Spark plans an equi-join. Without keys each
    interval is listed in several shares of its bins and each row looks into one, so that a week that
    holds all rows is many tasks.

    The levels that occur (32 at most) are counted in `right` while the join is built. With one, as where periods
    are about equally long, `left` is joined just as it is. With several, a row is repeated once per level,
    and all but inner joins regroup their result, since a row may match on some levels only.
    Joins that keep rows of `right` are refused: their intervals are listed more than once.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"join_range cannot keep the right side's rows: {how}")
    # Numbered names keep apart columns of both sides that are called the same, and helpers from either.
    a = left.select(*[F.col(f"`{c}`").alias(f"_l{i}") for i, c in enumerate(left.columns)])
    b = right.select(*[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(right.columns)])
    mine, theirs = dict(zip(left.columns, a.columns)), dict(zip(right.columns, b.columns))
    at, begin, stop = F.col(mine[ts]), F.col(theirs[start]), F.col(theirs[end])

    is_open = begin.isNull() | stop.isNull()
    first, last = F.coalesce(position(begin), F.lit(-FAR)), F.coalesce(position(stop), F.lit(FAR))
    level = F.when(is_open, OPEN).otherwise(_level(first, last))
    intervals = b.where(is_open | (begin < stop)).withColumn("_ilevel", level)
    occur = {r[0]: r[1] for r in intervals.groupBy("_ilevel").count().collect()}
    levels, salts = sorted(occur) or [0], max(1, min(SALTS, LISTINGS // max(1, sum(occur.values()))))
    ends = F.array_distinct(F.array(_bin(first, F.col("_ilevel")), _bin(last, F.col("_ilevel"))))
    listed = intervals.withColumn("_ibin", F.explode(ends))

    probes = a.withColumn("_level", F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*map(F.lit, levels))))
    probes = probes.withColumn("_bin", _bin(position(at), F.col("_level")))
    cond = [F.col("_bin") == F.col("_ibin"), F.col("_level") == F.col("_ilevel")]
    cond += equal_pairs(a, b, [(mine[x], theirs[y]) for x, y in keys])
    if not keys:
        listed = listed.withColumn("_ishare", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        probes = probes.withColumn("_share", share_of(a, F.lit(salts)))
        cond.append(F.col("_share") == F.col("_ishare"))
    cond += [begin.isNull() | (at >= begin), stop.isNull() | (at < stop)]
    met = probes.join(listed, cond, how)

    out = [F.col(n).alias(c) for c, n in mine.items()]
    if how in ("left", "inner"):
        out += [F.col(n).alias(c) for c, n in theirs.items()]
    if how == "inner" or len(levels) == 1:
        return met.select(*out)
    pair = [*a.columns, *b.columns, F.col("_ibin").isNotNull().alias("_found")] if how == "left" else a.columns
    grouped = met.groupBy(*pair).agg(F.count("*").alias("_n"), F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level")))).alias("_seen"))
    everywhere = F.col("_seen") == len(levels)
    if how == "left":
        kept = grouped.where(F.col("_found") | everywhere)
        return _repeated(kept, F.when(F.col("_found"), F.col("_n")).otherwise(F.floor(F.col("_n") / len(levels))), out)
    kept = grouped.where(everywhere) if how == "left_anti" else grouped
    return _repeated(kept, F.floor(F.col("_n") / F.col("_seen")), out)
