"""Windows over grouped rows, interval frames, and ranks that need no single task.

`cumulative`, `moving` and the like take frames that are already grouped to
(dimensions, order columns); a partition then holds at most one row per distinct
order value. Ranks over whole tables go through `ordered`, which cuts the value line
into ranges and works on one range per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from orrery.functions.dates import period_index
from orrery.functions.search import blocks, place

_AGG = {
    "sum": F.sum, "average": F.avg, "max": F.max, "min": F.min, "count": F.count,
    "stddev": F.stddev_samp, "median": lambda c: F.percentile(c, 0.5),
}


def _spec(dims: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return W.partitionBy(*dims).orderBy(*order)


def cumulative(fn: str, measure: str, order: Sequence[str], dims: Sequence[str] = ()) -> Column:
    """From the first row of the partition to this one."""
    return _AGG[fn](F.col(measure)).over(_spec(dims, order).rowsBetween(W.unboundedPreceding, 0))


def moving(fn: str, measure: str, start: int, end: int, order: Sequence[str], dims: Sequence[str] = ()) -> Column:
    """Rows from `start` back to `end` ahead: (3, -3) is exactly the row three back."""
    if -start > end:
        raise ValueError("the frame ends before it starts")
    if fn == "median":  # Spark has no median with a frame; the frame is short, so sort it
        held = F.sort_array(F.collect_list(measure).over(_spec(dims, order).rowsBetween(-start, end)))
        n = F.size(held)
        return F.when(n > 0, (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2.0)
    return _AGG[fn](F.col(measure)).over(_spec(dims, order).rowsBetween(-start, end))


def lag_n(measure: str, n: int, order: Sequence[str], dims: Sequence[str] = (), default=None) -> Column:
    return F.lag(measure, n, default).over(_spec(dims, order))


def lead_n(measure: str, n: int, order: Sequence[str], dims: Sequence[str] = (), default=None) -> Column:
    return F.lead(measure, n, default).over(_spec(dims, order))


previous_row = peek = lag_n


def trailing_interval(
    fn: str, measure: str, n: int, unit: str, order: str, dims: Sequence[str] = (), inclusive: bool = False
) -> Column:
    """The n units before this row's date, gaps counted; NULL if they hold no row."""
    w = _spec(dims, [period_index(F.col(order), unit)])
    return _AGG[fn](F.col(measure)).over(w.rangeBetween(-(n - 1) if inclusive else -n, 0 if inclusive else -1))


def leading_interval(
    fn: str, measure: str, n: int, unit: str, order: str, dims: Sequence[str] = (), inclusive: bool = False
) -> Column:
    w = _spec(dims, [period_index(F.col(order), unit)])
    return _AGG[fn](F.col(measure)).over(w.rangeBetween(0 if inclusive else 1, n - 1 if inclusive else n))


def window_all(fn: str, measure: str, dims: Sequence[str]) -> Column:
    """Over the whole partition."""
    return _AGG[fn](F.col(measure)).over(W.partitionBy(*dims))


def running_count(order: Sequence[str], dims: Sequence[str] = ()) -> Column:
    return F.count(F.lit(1)).over(_spec(dims, order).rowsBetween(W.unboundedPreceding, 0))


def partition_size(dims: Sequence[str]) -> Column:
    return F.count(F.lit(1)).over(W.partitionBy(*dims))


def _whole(dims, order) -> WindowSpec:
    return _spec(dims, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def first_value_at(measure: str, order: Sequence[str], dims: Sequence[str] = ()) -> Column:
    return F.first_value(F.col(measure)).over(_whole(dims, order))


def last_value_at(measure: str, order: Sequence[str], dims: Sequence[str] = ()) -> Column:
    return F.last_value(F.col(measure)).over(_whole(dims, order))


def nth_value(measure: str, n: int, order: Sequence[str], dims: Sequence[str] = ()) -> Column:
    return F.nth_value(measure, n).over(_whole(dims, order))


def row_offset_first(order: Sequence[str], dims: Sequence[str] = ()) -> Column:
    """0 on the first row, -1 on the second, and so on."""
    return 1 - F.row_number().over(_spec(dims, order))


def row_offset_last(order: Sequence[str], dims: Sequence[str] = ()) -> Column:
    """Rows that follow this one."""
    return partition_size(dims) - F.row_number().over(_spec(dims, order))


def rank_partitioned(measure: str, dims: Sequence[str], descending: bool = True) -> Column:
    by = F.col(measure).desc_nulls_last() if descending else F.col(measure).asc_nulls_last()
    return F.rank().over(_spec(dims, [by]))


# --- order over a whole table, one value range per task -------------------------------------


def _parts(df: DataFrame) -> int:
    """Value ranges to cut into: two for each task of a shuffle as the session is set for its data."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, value: str, ranges: int, to: str) -> DataFrame:
    """`df` with the number of its value range, about equal in distinct values.

    The cut points are quantiles of the 16 * ranges values with the smallest hashes, an even
    sample of the distinct values. They only decide which task orders which values.
    """
    h = F.xxhash64(value)
    some = df.select(value).distinct().orderBy(h, value).limit(16 * ranges)
    sample = some.agg(F.sort_array(F.collect_list(value)).alias("s"))
    cuts = sample.select(blocks(F.filter("s", lambda v, i: i % 16 == 15))).scalar()
    return df.withColumn("_cuts", cuts).withColumn(to, place(F.col(value), F.col("_cuts"))).drop("_cuts")


def ordered(df: DataFrame, value: str, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Each distinct non-null value with `_n`, `_before`, `_dense` and the total `_all`.

    `_n` rows hold the value, `_before` rows come earlier in the order, `_dense` counts
    the distinct values up to and including it. Rows are counted per value first, so a
    value that fills a third of the table is one row from then on. The values are cut
    into ranges; each range is ordered by itself and shifted by the totals of the ranges
    ahead of it.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    cut = _ranged(counted, value, ranges or _parts(df), "_place")
    cut = cut.withColumn("_range", -F.col("_place") if descending else F.col("_place")).drop("_place")
    by = F.col(value).desc() if descending else F.col(value).asc()
    inside = W.partitionBy("_range").orderBy(by)
    ahead = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    shift = cut.groupBy("_range").agg(F.sum("_n").alias("_rn"), F.count("*").alias("_rd")).select(
        "_range",
        F.coalesce(F.sum("_rn").over(ahead), F.lit(0)).alias("_shift"),
        F.coalesce(F.sum("_rd").over(ahead), F.lit(0)).alias("_dshift"),
        F.sum("_rn").over(W.partitionBy()).alias("_all"),
    )
    local = cut.withColumn(
        "_lb", F.coalesce(F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_ld", F.row_number().over(inside))
    return local.join(shift, "_range").select(
        value, "_n",
        (F.col("_shift") + F.col("_lb")).alias("_before"),
        (F.col("_dshift") + F.col("_ld")).alias("_dense"),
        "_all",
    )


def global_ranks(df: DataFrame, value: str, descending: bool = False, tie: str | None = None, tiles: int = 4) -> DataFrame:
    """`df` with rank, dense_rank, percent_rank, cume_dist and rank_percentile over all rows.

    With `tie`, a column that is unique among rows of equal value, also row_number and
    ntile. Rows whose value is NULL get NULL.
    """
    o = ordered(df, value, descending).withColumnRenamed(value, "_ov")
    out = df.join(o, df[value] == o["_ov"], "left")
    before, n, all_ = F.col("_before"), F.col("_n"), F.col("_all")
    pct = F.when(all_ > 1, before / (all_ - 1)).when(all_ == 1, 0.0)
    cols = {
        "rank": before + 1,
        "dense_rank": F.col("_dense"),
        "percent_rank": pct,
        "cume_dist": (before + n) / all_,
        "rank_percentile": (1 - pct) * 100,
    }
    if tie is not None:
        same = _tie_places(df, value, tie)
        out = out.join(same, (df[value] == same["_tv"]) & (df[tie] == same["_tt"]), "left")
        number = before + F.col("_place")
        small, more = F.floor(all_ / tiles), all_ % tiles
        edge = more * (small + 1)
        cols["row_number"] = number
        cols["ntile"] = F.when(number <= edge, F.floor((number - 1) / (small + 1)) + 1).when(
            number > edge, more + F.floor((number - 1 - edge) / F.greatest(small, F.lit(1))) + 1
        )
    return out.select(df["*"], *[c.alias(k) for k, c in cols.items()])


def _tie_places(df: DataFrame, value: str, tie: str, ranges: int | None = None) -> DataFrame:
    """Place of each row among rows of equal value, in the order of the tie column.

    Ranges of the tie column split a value that fills a third of the table.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_tv"), F.col(tie).alias("_tt"))
    cut = _ranged(rows, "_tt", ranges or _parts(df), "_r")
    ahead = W.partitionBy("_tv").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    shift = cut.groupBy("_tv", "_r").agg(F.count("*").alias("_c")).select(
        "_tv", "_r", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_shift")
    )
    local = cut.withColumn("_local", F.row_number().over(W.partitionBy("_tv", "_r").orderBy("_tt")))
    return local.join(shift, ["_tv", "_r"]).select("_tv", "_tt", (F.col("_shift") + F.col("_local")).alias("_place"))


def rank(df: DataFrame, measure: str, descending: bool = True, to: str = "rank") -> DataFrame:
    """Competition rank over all rows; NULL measures come last."""
    o = ordered(df, measure, descending).select(F.col(measure).alias("_ov"), (F.col("_before") + 1).alias("_rank"))
    filled = df.agg(F.count(measure)).scalar()
    out = df.join(o, df[measure] == o["_ov"], "left")
    return out.select(df["*"], F.coalesce(F.col("_rank"), filled + 1).alias(to))


def field_values(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value of an attribute with its position in ascending order, from 1."""
    return ordered(df, column).select(column, F.col("_dense").alias("field_index"))
