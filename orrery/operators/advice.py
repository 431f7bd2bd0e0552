"""Rollup advice over tables of query shapes.

A shape is a row (shape_id, dimensions, dates, measures, filter_columns, weight); a candidate is
(rollup_id, dimensions, dates[, agg_rows, base_rows]). Arrays hold column names, and `dates` one
(column, bucket) for every date column that is grouped by, a NULL bucket standing for the raw date. Frames with
`date_column` and `bucket` in place of `dates` hold one date at most. Shapes are the distinct ones of a log,
counted, so these frames are small beside the data; still nothing is collected but one chosen row per round.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.dates import BUCKETS
from orrery.operators.keys import join_on
from orrery.operators.rollups import MAKES, Plan
from orrery.session import fresh_path, settled



CURVE = "step int, rollup_id string, benefit double, coverage_pct double, compression double"
DATES = "array<struct<column: string, bucket: string>>"


def _empty() -> Column:
    return F.array().cast("array<string>")


def with_dates(df: DataFrame) -> DataFrame:
    """The frame with `dates`, made from `date_column` and `bucket` where it has none."""
    if "dates" in df.columns:
        return df
    one = F.array(F.struct(F.col("date_column").alias("column"), F.col("bucket").alias("bucket")))
    return df.withColumn("dates", F.when(F.col("date_column").isNotNull(), one).otherwise(F.array()).cast(DATES))


def _columns_of(dates: Column) -> Column:
    """The date columns, in order."""
    return F.array_sort(F.array_distinct(F.transform(dates, lambda d: d["column"])))


def query_shapes(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal shapes counted into one, with the count as weight and a readable id."""
    cols = [*keys]
    counted = log.groupBy(*cols).agg(F.count("*").cast("double").alias("weight"))
    dated = lambda d: F.concat_ws("@", d["column"], d["bucket"])
    parts = [
        F.array_join(F.array_sort(F.transform(c, dated)) if "struct" in t else F.col(c), "+") if t.startswith("array") else F.coalesce(F.col(c), F.lit("-"))
        for c, t in log.select(*cols).dtypes
    ]
    return counted.withColumn("shape_id", F.concat_ws("|", *parts))


def grouped_names(text: Column) -> tuple[Column, Column]:
    """The terms of a query's GROUP BY that are names (upper case, unquoted), and whether it has others."""
    after = F.get(F.split(text, r"(?i)\bgroup\s+by\b"), F.lit(1))
    clause = F.get(F.split(after, r"(?i)\b(?:order|having|limit)\b|;"), F.lit(0))
    # A comma inside the parentheses of a call does not end a term.
    terms = F.transform(F.regexp_extract_all(clause, F.lit(r"(?:[^,(]|\([^)]*\))+"), F.lit(0)), lambda t: F.trim(t))
    terms = F.filter(F.coalesce(terms, _empty()), lambda t: F.length(t) > 0)
    bare = F.transform(terms, lambda t: F.upper(F.translate(t, '"`', "")))
    names = F.filter(bare, lambda t: F.regexp_count(t, F.lit(r"[^\w.]")) == 0)
    return names, F.size(names) != F.size(terms)


def mine_query_log(log: DataFrame, text: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """Group-by shapes of logged SQL with their counts: (columns, had_dropped, queries).

    `names` maps physical names to those of the model; unknown ones are left out.
    """
    cols, dropped = grouped_names(F.col(text))
    parsed = log.select(cols.alias("columns"), dropped.alias("had_dropped"))
    if names is not None:
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        parsed = parsed.withColumn("columns", F.filter(F.transform("columns", lambda n: F.try_element_at(table, n)), lambda n: n.isNotNull()))
    return (
        parsed.withColumn("columns", F.array_sort(F.array_distinct("columns")))
        .filter(F.size("columns") > 0)
        .groupBy("columns", "had_dropped")
        .agg(F.count("*").alias("queries"))
    )


def weigh_shapes(shapes: DataFrame, mined: DataFrame) -> DataFrame:
    """Shapes weighted by 1 plus the logged queries of their grain.

    A wholly parsed query matches dims, or dims with the dates; one with a dropped term is
    taken as date-bucketed and matches only the dims of dated shapes.
    """
    shapes = with_dates(shapes)
    dims = F.array_sort("dimensions")
    dated = F.array_sort(F.array_union("dimensions", _columns_of(F.col("dates"))))
    way = lambda k, d: F.struct(k.alias("k"), F.lit(d).alias("d"))
    ways = F.when(F.size("dates") > 0, F.array(way(dims, False), way(dated, False), way(dims, True))).otherwise(F.array(way(dims, False)))
    keyed = shapes.select("shape_id", F.explode(ways).alias("m")).select("shape_id", "m.k", "m.d")
    hits = keyed.join(mined, (F.col("k") == F.col("columns")) & (F.col("d") == F.col("had_dropped")))
    seen = hits.groupBy("shape_id").agg(F.sum("queries").alias("_seen"))
    return join_on(shapes.drop("weight"), seen, ["shape_id"], "left").withColumn(
        "weight", 1.0 + F.coalesce(F.col("_seen"), F.lit(0))
    ).drop("_seen")


def _bucket_ok(have: Column, want: Column) -> Column:
    """`rollups.regroups` on columns."""
    fits = [(have == kept) & want.isin(*asked) for kept, asked in MAKES.items()]
    return F.coalesce(reduce(or_, fits), F.lit(False)) | have.isNull()


def coverage(shapes: DataFrame, candidates: DataFrame, plans: Sequence[Plan]) -> DataFrame:
    """Which candidate serves which shape: (rollup_id, shape_id, weight).

    Shapes meet candidates on one of their columns (or on '*' if they have none), then
    all conditions are checked: dims and filters in the grain, but for filters on the shape's own dates;
    for each date of the shape the same column in the grain, by a finer or equal bucket;
    measures decomposable or their column in the grain.
    """
    shapes, candidates = with_dates(shapes), with_dates(candidates)
    known = [p.measure.name for p in plans]
    needs = {p.measure.name: p.requires for p in plans if not p.decomposable}
    required = F.array_compact(F.transform("measures", lambda m: F.coalesce(*[F.when(m == n, F.lit(r)) for n, r in needs.items()]))) if needs else _empty()
    wanted = shapes.select(
        "shape_id", "weight", F.col("dates").alias("_dates"),
        F.array_union(F.array_union("dimensions", F.array_except("filter_columns", _columns_of(F.col("dates")))), required).alias("_cols"),
        F.size(F.array_except("measures", F.array(*[F.lit(k) for k in known]))).alias("_unknown"),
    ).filter("_unknown = 0").withColumn("_meet", F.coalesce(F.array_min("_cols"), F.lit("*")))
    offered = candidates.select(
        "rollup_id", F.col("dimensions").alias("_dims"), F.col("dates").alias("_kept"),
        F.explode(F.array_union("dimensions", F.array(F.lit("*")))).alias("_at"),
    )
    dated = F.forall("_dates", lambda d: F.exists("_kept", lambda k: (k["column"] == d["column"]) & _bucket_ok(k["bucket"], d["bucket"])))
    return wanted.join(offered, F.col("_meet") == F.col("_at")).filter(
        (F.size(F.array_except("_cols", "_dims")) == 0) & dated
    ).select("rollup_id", "shape_id", "weight")


def coverage_report(shapes: DataFrame, candidates: DataFrame, plans: Sequence[Plan]) -> DataFrame:
    """Per candidate (with agg_rows and base_rows): shapes and weight served, share of all weight, and rows saved."""
    per = coverage(shapes, candidates, plans).groupBy("rollup_id").agg(F.count("*").alias("shapes"), F.sum("weight").alias("weight"))
    all_weight = shapes.agg(F.sum("weight")).scalar()
    out = join_on(candidates.select("rollup_id", "agg_rows", "base_rows"), per, ["rollup_id"], "left").withColumns(
        {"shapes": F.coalesce("shapes", F.lit(0)), "weight": F.coalesce("weight", F.lit(0.0))}
    )
    return out.withColumn("coverage_pct", F.round(100.0 * F.col("weight") / all_weight, 1)).withColumn(
        "rows_saved", F.col("weight") * F.greatest(F.col("base_rows") - F.col("agg_rows"), F.lit(0))
    ).drop("base_rows")


def consolidation_report(shapes: DataFrame, candidates: DataFrame, plans: Sequence[Plan]) -> DataFrame:
    """One wide rollup against the single-column ones whose shapes it all serves (two or more)."""
    served = settled(coverage(shapes, candidates, plans).select("rollup_id", "shape_id"))
    wide = candidates.filter(F.size("dimensions") > 1).select(F.col("rollup_id").alias("combined"), F.explode("dimensions").alias("_dim"), F.col("agg_rows").alias("combined_rows"))
    narrow = candidates.filter(F.size("dimensions") == 1).select("rollup_id", F.get("dimensions", F.lit(0)).alias("_dim"), "agg_rows")
    pairs = wide.join(narrow, "_dim")
    of_narrow = join_on(pairs, served, ["rollup_id"])
    by_wide = served.select(F.col("rollup_id").alias("combined"), "shape_id", F.lit(1).alias("_both"))
    both = join_on(of_narrow, by_wide, ["combined", "shape_id"], "left")
    inside = both.groupBy("combined", "combined_rows", "rollup_id", "agg_rows").agg(
        F.count("*").alias("_n"), F.count("_both").alias("_b")
    ).filter("_n = _b")
    return inside.groupBy("combined", "combined_rows").agg(
        F.count("*").alias("narrow"), F.sum("agg_rows").alias("narrow_total_rows")
    ).filter("narrow >= 2")


def candidate_grains(
    shapes: DataFrame, plans: Sequence[Plan], similar: float = 0.5, wide: int = 8, consolidatable: Sequence[str] = ()
) -> DataFrame:
    """Grains worth storing: those of the shapes, unions of similar ones, and one of all columns.

    Sets are similar if they share at least the given part of their union; only grains with the same date columns
    are joined. Pairs are found on a shared column among the first few of each sorted set. This loses no pair: sets of a
    and b columns that share too few to meet there are below the wanted likeness. Grains of more
    than `wide` columns are kept and flagged. Each date column's bucket is the finest that a served shape asks
    of it, whatever the other dates' buckets are; a shape that groups by the raw date makes it raw.
    Of two dates or more, `date_column` and `bucket` hold the first.
    """
    shapes = with_dates(shapes)
    on = _columns_of(F.col("dates"))
    cols = F.array_sort(F.array_union("dimensions", F.array_except("filter_columns", on)))
    base = shapes.select(cols.alias("dims"), on.alias("on")).distinct()
    keep = F.size("dims") - F.ceil(F.lit(similar) * F.size("dims")).cast("int") + 1
    probe = base.select("dims", "on", F.explode(F.slice("dims", F.lit(1), F.greatest(keep, F.lit(1)))).alias("_at"))
    other = probe.select(F.col("dims").alias("_dims"), F.col("on").alias("_on"), F.col("_at").alias("_oat"))
    union, common = F.array_union("dims", "_dims"), F.array_intersect("dims", "_dims")
    merged = probe.join(
        other, (F.col("_at") == F.col("_oat")) & (F.col("on") == F.col("_on")) & (F.array_join("dims", ",") < F.array_join("_dims", ",")),
    ).filter(F.size(common) >= similar * F.size(union)).select(F.array_sort(union).alias("dims"), "on")
    grains = base.unionByName(merged)
    if consolidatable:
        # One list of distinct names a set of dates: at most all of `consolidatable`.
        each = base.select("on", F.explode("dims").alias("_dim")).where(F.col("_dim").isin(list(consolidatable))).distinct()
        whole = each.groupBy("on").agg(F.array_sort(F.collect_list("_dim")).alias("dims")).filter(F.size("dims") >= 2)
        grains = grains.unionByName(whole.select("dims", "on"))
    raw = F.transform("on", lambda c: F.struct(c.alias("column"), F.lit(None).cast("string").alias("bucket")))
    grains = grains.distinct().select(
        F.concat_ws("|", F.array_join("dims", "+"), F.when(F.size("on") > 0, F.array_join("on", "+")).otherwise("-")).alias("rollup_id"),
        F.col("dims").alias("dimensions"), raw.alias("dates"),
    )
    served = join_on(coverage(shapes, grains, plans).select("rollup_id", "shape_id"), shapes.select("shape_id", "dates"), ["shape_id"])
    asked = served.select("rollup_id", F.explode("dates").alias("_d")).select("rollup_id", F.col("_d.column").alias("column"), F.col("_d.bucket").alias("_b"))
    fine = F.coalesce(*[F.when(F.col("_b") == b, F.lit(i)) for i, b in enumerate(BUCKETS)])
    mixed = (F.max((F.col("_b") == "WEEKLY").cast("int")) == 1) & (F.max(F.col("_b").isin(*BUCKETS[3:]).cast("int")) == 1)
    finest = asked.groupBy("rollup_id", "column").agg(
        F.bool_or(F.col("_b").isNull()).alias("_raw"), F.when(mixed, F.least(F.min(fine), F.lit(1))).otherwise(F.min(fine)).alias("_f"))
    named = F.when(~F.col("_raw"), F.coalesce(*[F.when(F.col("_f") == i, F.lit(b)) for i, b in enumerate(BUCKETS)]))
    # A grain's dates are those of its shapes, so that few of them are gathered, once each.
    per_date = grains.select("rollup_id", F.explode("dates.column").alias("column"))
    dates = join_on(per_date, finest.select("rollup_id", "column", named.alias("bucket")), ["rollup_id", "column"], "left") \
        .groupBy("rollup_id").agg(F.array_sort(F.collect_list(F.struct("column", "bucket"))).alias("dates"))
    out = join_on(join_on(grains.drop("dates"), served.groupBy("rollup_id").agg(F.count("*").alias("covered")), ["rollup_id"]), dates, ["rollup_id"], "left")
    first = F.get("dates", F.lit(0))
    return out.select(
        "rollup_id", "dimensions", F.coalesce("dates", F.array().cast(DATES)).alias("dates"), first["column"].alias("date_column"),
        first["bucket"].alias("bucket"), "covered", (F.size("dimensions") > wide).alias("wide_grain"),
    )


def choose_rollups(shapes: DataFrame, candidates: DataFrame, plans: Sequence[Plan], rounds: int | None = None) -> DataFrame:
    """Greedy choice: each step takes the rollup that saves most rows times weight against the best choice so far.

    Rollups without `agg_rows` cannot be costed and are left out; where none has a size, or there is no
    `base_rows`, a step takes the rollup that serves most weight not yet served, and no compression is told. Goes on until no
    rollup gains, or for `rounds` picks; equal gains go to the smaller id. Each step depends on the one before, so
    steps are jobs of their own: a step groups the coverage against the best choice of each shape, and that choice and
    the pick are written. Only the pick's id and gain come to the driver. Returns the curve, read back: (step,
    rollup_id, benefit, coverage_pct, compression).
    """
    spark = shapes.sparkSession
    for name in ("agg_rows", "base_rows"):
        if name not in candidates.columns:
            candidates = candidates.withColumn(name, F.lit(None).cast("long"))
    sized = candidates.where("agg_rows IS NOT NULL AND base_rows IS NOT NULL").limit(1).count() > 0
    # Unsized, every rollup costs nothing and the base one: what is saved is the weight served for the first time.
    costs = candidates.where("agg_rows IS NOT NULL").select("rollup_id", "agg_rows", "base_rows") if sized \
        else candidates.select("rollup_id", F.lit(0).alias("agg_rows"), F.lit(1).alias("base_rows"))
    served = settled(join_on(coverage(shapes, candidates, plans), costs, ["rollup_id"]))
    best = served.groupBy("shape_id").agg(F.max("base_rows").alias("_best"))
    total = shapes.agg(F.sum("weight")).scalar()
    path = fresh_path(spark, "rollup-curve")
    spark.createDataFrame([], CURVE).write.parquet(path)
    step = 0
    while rounds is None or step < rounds:
        best, step = settled(best), step + 1
        gain = F.sum(F.col("weight") * F.greatest(F.col("_best") - F.col("agg_rows"), F.lit(0)))
        gains = join_on(served, best, ["shape_id"]).groupBy("rollup_id").agg(gain.alias("benefit"), F.min("agg_rows").alias("agg_rows"), F.max("base_rows").alias("base_rows"))
        pick = gains.orderBy(F.col("benefit").desc(), "rollup_id").first()
        if pick is None or pick.benefit <= 0:
            break
        mine = served.where(F.col("rollup_id") == pick.rollup_id).select("shape_id", F.col("agg_rows").alias("_mine"))
        # A rollup that was taken gains nothing again, since its shapes now cost no more than it.
        best = join_on(best, mine, ["shape_id"], "left").select("shape_id", F.least("_best", "_mine").alias("_best"))
        reached = join_on(served, best, ["shape_id"]).where("_best < base_rows").select("shape_id", "weight").distinct().agg(F.sum("weight")).scalar()
        compression = F.round(F.lit(pick.base_rows) / F.lit(pick.agg_rows), 1) if sized and pick.agg_rows else F.lit(None)
        spark.range(1).select(
            F.lit(step).alias("step"), F.lit(pick.rollup_id).alias("rollup_id"), F.lit(float(pick.benefit)).alias("benefit"),
            F.round(100.0 * reached / total, 1).alias("coverage_pct"), compression.cast("double").alias("compression")).write.mode("append").parquet(path)
    return spark.read.schema(CURVE).parquet(path)
