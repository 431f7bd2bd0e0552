"""Group aggregates that need more than one stage, and the shapes built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.functions.search import blocks, place
from orrery.operators.keys import beside, beside_group, join_on
from orrery.session import settled

# A bracket with more distinct values is cut into so many ranges.
HELD, RANGES = 4096, 64


def _named(measures: Mapping[str, Column]) -> list[Column]:
    return [m.alias(n) for n, m in measures.items()]


def sum_distinct_key(df: DataFrame, groups: Sequence[str], key: str, value: str, to: str) -> DataFrame:
    """Sum a value once per key, however often the key is repeated."""
    once = df.groupBy(*groups, key).agg(F.max(value).alias("_v"))
    return once.groupBy(*groups).agg(F.sum("_v").alias(to))


def mode(df: DataFrame, groups: Sequence[str], value: str, to: str) -> DataFrame:
    """Most frequent value; the smallest one on ties, NULL for a group without values.

    Counted per value first, so no group has to hold all of its values in one buffer.
    """
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    order = F.struct(F.col(value).isNull(), -F.col("_n"), F.col(value))
    return counted.groupBy(*groups).agg(F.min_by(F.col(value), order).alias(to))


def percentiles(
    df: DataFrame, groups: Sequence[str], value: str, wanted: Mapping[str, tuple[float, str]], accuracy: int = 10_000, held: int = HELD,
) -> DataFrame:
    """Exact percentiles per group by selection: the range with the wanted rank is opened until it is small.

    `wanted` maps an output name to (p, "cont" | "disc"). One scan sketches each group's quantiles and counts its
    values, groups of NULLs included. A second one counts, per group, the rows below each wanted percentile's bracket
    and the rows of every value inside it, with the nearest values outside; large groups' rows meet their brackets
    where they lie (`beside_group`), and only those few values are shuffled. While a bracket holds more than `held`
    distinct values, they are cut into ranges, the ranges counted, and only those with a wanted rank kept
    (`_narrowed`). No group and no bracket is put in order by one task.

    A rank that lies outside its bracket, which the error bound of the sketch excludes, raises an error instead of
    a wrong answer. Discrete percentiles alone keep the column's type. A group without values gives NULL.
    """
    g = list(groups) or ["_everything"]
    exact = all(kind == "disc" for _, kind in wanted.values()) and df.schema[value].dataType.typeName() != "string"
    v = F.col(value) if exact else F.col(value).cast("double")
    rows = df.select(*groups, v.alias("_v"))
    kind_of = rows.schema["_v"].dataType
    whole = lambda d: d if groups else d.withColumn("_everything", F.lit(0))
    slack = 4.0 / accuracy
    edge = {n: (max(0.0, p - slack), min(1.0, p + slack)) for n, (p, _) in wanted.items()}
    probs = sorted({e for pair in edge.values() for e in pair})
    ask = F.array(*[F.lit(p) for p in probs])
    sketch = settled(rows.groupBy(*groups).agg(F.percentile_approx("_v", ask, accuracy).alias("_q"), F.count("_v").alias("_all")))

    bounds = [tuple(F.get("_q", F.lit(probs.index(e))) for e in edge[n]) for n in wanted]
    framed = whole(beside_group(rows.where(F.col("_v").isNotNull()), sketch, groups, "_all"))
    sketch = whole(sketch)
    within = [F.col("_v").between(lo, hi) for lo, hi in bounds]
    inside = reduce(or_, within)
    tallies = [c for i, (lo, hi) in enumerate(bounds) for c in (
        F.count(F.when(F.col("_v") < lo, 1)).alias(f"_b{i}"), F.max(F.when(F.col("_v") < lo, F.col("_v"))).alias(f"_lower{i}"),
        F.min(F.when(F.col("_v") > hi, F.col("_v"))).alias(f"_upper{i}"))]
    kept = [F.when(inside, F.col("_v")).alias("_kept"), F.when(inside, F.array(*within)).alias("_in")]  # the second follows from the first
    tallied = settled(framed.groupBy(*g, *kept).agg(F.count("*").alias("_n"), *tallies))

    again = [c for i in range(len(bounds)) for c in (
        F.sum(f"_b{i}").alias(f"_b{i}"), F.max(f"_lower{i}").alias(f"_lower{i}"), F.min(f"_upper{i}").alias(f"_upper{i}"))]
    state = join_on(sketch, tallied.groupBy(*g).agg(*again), g)
    # One row a group and percentile: the 0-based ranks in its bracket on either side of the wanted one, what lies around.
    marks = []
    for i, (p, kind) in enumerate(wanted.values()):
        rank = F.lit(p) * (F.col("_all") - 1) if kind == "cont" else F.greatest(F.ceil(F.lit(p) * F.col("_all")) - 1, F.lit(0))
        rank = rank.cast("double")
        marks.append(F.struct(
            F.lit(i).alias("i"), (F.floor(rank) - F.col(f"_b{i}")).alias("low_rank"), (F.ceil(rank) - F.col(f"_b{i}")).alias("high_rank"),
            (rank - F.floor(rank)).alias("part"), F.col(f"_lower{i}").alias("lower"), F.col(f"_upper{i}").alias("upper")))
    targets = state.where("_all > 0").select(*g, F.explode(F.array(*marks)).alias("_t")).select(*g, "_t.*")
    held_in = tallied.where(F.col("_kept").isNotNull()).select(*g, F.posexplode("_in").alias("i", "_holds"), F.col("_kept").alias("v"), F.col("_n").alias("n"))
    near = held_in.where("_holds").drop("_holds")

    at = [*g, "i"]
    most = near.groupBy(*at).count().agg(F.max("count")).first()[0] or 0
    while most > held:
        near, targets = _narrowed(near, targets, at)
        most = near.groupBy(*at).count().agg(F.max("count")).first()[0]
    # At most `held` values a group and percentile from here on.
    listed = near.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("_vs"))
    picked = join_on(targets, listed, at, "left")
    lost = F.raise_error(F.lit("a bracket misses its rank; use a greater accuracy")).cast(kind_of)
    low, high = (F.coalesce(_nth(F.col(r), kind_of), lost) for r in ("low_rank", "high_rank"))
    part = F.col("part")
    answers = [F.when(F.col("i") == i, low + (high - low) * part if kind == "cont" else low) for i, (_, kind) in enumerate(wanted.values())]
    found = picked.select(*g, *[x.alias(n) for x, n in zip(answers, wanted)]).groupBy(*g).agg(*[F.max(n).alias(n) for n in wanted])
    return join_on(sketch.select(*g), found, g, "left").select(*groups, *wanted)


def _nth(rank: Column, kind) -> Column:
    """The value of a 0-based rank among the counted values `_vs` of a bracket, or its neighbour right outside; else NULL."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(kind).alias("hit"))
    walked = F.aggregate("_vs", start, lambda acc, x: F.struct(
        (acc["seen"] + x["n"]).alias("seen"), F.when(acc["hit"].isNull() & (acc["seen"] + x["n"] > rank), x["v"]).otherwise(acc["hit"]).alias("hit")))
    outside = F.when(rank == F.coalesce(walked["seen"], F.lit(0)), F.col("upper"))
    return F.when(rank == -1, F.col("lower")).when(rank >= 0, F.coalesce(walked["hit"], outside))


def _narrowed(near: DataFrame, targets: DataFrame, at: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Only the values of the ranges with a wanted rank, of `RANGES` about equal ones, and the ranks among them."""
    ask = F.array(*[F.lit(j / RANGES) for j in range(1, RANGES)])
    cuts = near.groupBy(*at).agg(blocks(F.percentile_approx("v", ask, 16 * RANGES)).alias("_cuts"), F.count("*").alias("_size"))
    cut = beside_group(near, settled(cuts), at, "_size").withColumn("_r", place(F.col("v"), F.col("_cuts"))).drop("_cuts", "_size")
    along = W.partitionBy(*at).orderBy("_r")  # at most RANGES rows
    counted = cut.groupBy(*at, "_r").agg(F.sum("n").alias("_c"))
    counted = counted.withColumn("_upto", F.sum("_c").over(along)).withColumn("_ahead", F.col("_upto") - F.col("_c"))
    holds = lambda r: (F.col("_ahead") <= F.col(r)) & (F.col(r) < F.col("_upto"))
    opened = settled(join_on(counted, targets.select(*at, "low_rank", "high_rank"), at).where(holds("low_rank") | holds("high_rank")).select(*at, "_r", "_ahead"))
    shift = opened.groupBy(*at).agg(F.min("_ahead").alias("_shift"))
    none = F.when(F.col("low_rank") < 0, F.lit(0)).otherwise(F.col("low_rank"))
    moved = join_on(targets, shift, at, "left").withColumn("_shift", F.coalesce("_shift", none))
    moved = moved.withColumns({r: F.col(r) - F.col("_shift") for r in ("low_rank", "high_rank")}).drop("_shift")
    return settled(join_on(cut, opened.drop("_ahead"), [*at, "_r"]).drop("_r")), settled(moved)


def nth_by_value(df: DataFrame, groups: Sequence[str], value: str, n: int, to: str, largest: bool = True) -> DataFrame:
    """The nth largest (or smallest) value per group, repeated values counted separately; NULL if there are fewer.

    Counted per value first, NULL too, so that no group is lost; each group keeps at most n + 1 candidates per
    task before anything is gathered.
    """
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    by = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    place_of = W.partitionBy(*groups).orderBy(by)
    few = counted.withColumn("_place", F.row_number().over(place_of)).filter(F.col("_place") <= n)
    reached = few.withColumn("_upto", F.sum("_n").over(place_of.rowsBetween(W.unboundedPreceding, 0)))
    pick = F.max if largest else F.min
    return reached.groupBy(*groups).agg(pick(F.when(F.col("_upto") >= n, F.col(value))).alias(to))


def string_list(df: DataFrame, groups: Sequence[str], value: str, to: str, delimiter: str = ", ") -> DataFrame:
    """Distinct values of a group as one ordered, delimited text; NULL for a group without values.

    The text holds every value, so a group's values must fit in one task.
    """
    once = df.select(*groups, value).distinct()
    listed = F.array_sort(F.collect_list(value))
    return once.groupBy(*groups).agg(F.when(F.size(listed) > 0, F.array_join(listed, delimiter)).alias(to))


def pivot_by_condition(
    df: DataFrame, groups: Sequence[str], on: Column, values: Mapping[str, object], measure: Column
) -> DataFrame:
    """One summed column per listed value of `on`."""
    return df.groupBy(*groups).agg(*[F.sum(F.when(on == v, measure)).alias(n) for n, v in values.items()])


def unpivot_columns(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Columns to rows."""
    return df.unpivot(list(ids), list(columns), name, value)


def nested_aggregate(
    df: DataFrame, inner: Sequence[str], inner_measures: Mapping[str, Column], outer: Sequence[str], outer_measures: Mapping[str, Column]
) -> DataFrame:
    """An aggregate of an aggregate: group finely, then group the result."""
    return df.groupBy(*inner).agg(*_named(inner_measures)).groupBy(*outer).agg(*_named(outer_measures))


def metric_on_metric(
    child: DataFrame, fk: str, inner: Mapping[str, Column], parent: DataFrame, pk: str,
    groups: Sequence[str], outer: Mapping[str, Column],
) -> DataFrame:
    """Group the child by its parent key, join the parent, group again."""
    grouped = child.groupBy(F.col(fk).alias("_k")).agg(*_named(inner))
    return parent.join(grouped, parent[pk] == grouped["_k"], "inner").groupBy(*groups).agg(*_named(outer))


def stat_over_aggregate(df: DataFrame, groups: Sequence[str], measure: Column, name: str) -> DataFrame:
    """Group totals with the mean and sample deviation of all totals beside each.

    The two figures come from a scalar subquery over the grouped rows; a window over
    everything would put them all into one task.
    """
    totals = df.groupBy(*groups).agg(measure.alias(name))
    stats = totals.agg(F.avg(name).alias("mean"), F.stddev_samp(name).alias("std_dev"))
    return beside(totals, stats)


def outlier_flag(df: DataFrame, groups: Sequence[str], measure: Column, name: str, z: float) -> DataFrame:
    """Group totals with their z-score and whether it is beyond `z` on either side."""
    s = stat_over_aggregate(df, groups, measure, name)
    score = F.try_divide(F.col(name) - F.col("mean"), F.col("std_dev"))
    return s.withColumn("z_score", score).withColumn("is_outlier", F.coalesce(F.abs(score) > z, F.lit(False)))


def grouping(df: DataFrame, kind: str, columns: Sequence[str], measures: Mapping[str, Column], sets: Sequence[Sequence[str]] = ()) -> DataFrame:
    """`rollup`, `cube` or explicit grouping sets, with `grouping_id` to tell the levels apart."""
    if kind == "sets":
        cols = [F.col(c) for c in columns]
        grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
    else:
        grouped = getattr(df, kind)(*columns)
    return grouped.agg(F.grouping_id().alias("grouping_id"), *_named(measures))
