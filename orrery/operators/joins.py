"""Joins over star schemas: equi, range, as-of, semi and anti, and the multi-fact shapes.

No join carries a broadcast hint. Spark broadcasts a side whose measured size is
below `spark.sql.autoBroadcastJoinThreshold`, statically or at run time, and
shuffles otherwise; skewed keys of shuffled joins are split at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.operators.keys import beside, equal_pairs, join_on
from orrery.operators.ranges import join_range  # noqa: F401
from orrery.operators.segments import cut_hot
from orrery.session import settled


@dataclass(frozen=True)
class Dim:
    """A dimension to attach: `on` pairs a column of the frame so far with one of the table.

    `prefix` renames the columns of the table, so that one table can be attached
    several times in different roles. `keep` limits the columns brought in.
    """

    table: DataFrame
    on: Sequence[tuple[str, str]]
    how: str = "inner"
    prefix: str = ""
    keep: Sequence[str] | None = None


def star_join(fact: DataFrame, *dims: Dim) -> DataFrame:
    """Attach dimensions one after another; later ones may hang on earlier ones."""
    out = fact
    for d in dims:
        names = d.table.columns if d.keep is None else list(dict.fromkeys([*(k for _, k in d.on), *d.keep]))
        side = d.table.select(*[d.table[c].alias(d.prefix + c) for c in names])
        out = out.join(side, equal_pairs(out, side, [(a, d.prefix + b) for a, b in d.on]), d.how)
    return out


def semi_join(df: DataFrame, members: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose key is in `members`; duplicates on the member side never multiply rows."""
    return df.join(members, equal_pairs(df, members, on), "left_semi")


def anti_join(df: DataFrame, members: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose key is not in `members`; a NULL key is never a member."""
    return df.join(members, equal_pairs(df, members, on), "left_anti")


exists_in = semi_join


cross_scalar = beside


def outer_members(
    dim: DataFrame, key: str, fact: DataFrame, fact_key: str, measures: Mapping[str, Column]
) -> DataFrame:
    """Every member of the dimension with its measures, NULL where it has no facts."""
    grouped = fact.groupBy(F.col(fact_key).alias("_k")).agg(*[m.alias(n) for n, m in measures.items()])
    return dim.join(grouped, dim[key] == grouped["_k"], "left").drop("_k")


def drill_across(facts: Sequence[DataFrame], dims: Sequence[str]) -> DataFrame:
    """Side by side the measures of several frames, each already grouped by the shared dims.

    The frames are stacked and regrouped, which is a full join that also matches NULL
    keys. Measure names must differ between the frames.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    measures = [c for c in stacked.columns if c not in dims]
    if len(measures) != sum(len(f.columns) - len(dims) for f in facts):
        raise ValueError("measure names repeat between the facts")
    return stacked.groupBy(*dims).agg(*[F.max(m).alias(m) for m in measures])


def fan_trap_safe(
    header: DataFrame, header_key: str, detail: DataFrame, detail_key: str, detail_measures: Mapping[str, Column]
) -> DataFrame:
    """Header rows with the totals of their details: one row per header, nothing multiplied."""
    grouped = detail.groupBy(F.col(detail_key).alias("_k")).agg(
        *[m.alias(n) for n, m in detail_measures.items()]
    )
    return header.join(grouped, header[header_key] == grouped["_k"], "left").drop("_k")


def blend_left(
    primary: DataFrame,
    secondary: DataFrame,
    links: Sequence[str],
    primary_measures: Mapping[str, Column],
    secondary_measures: Mapping[str, Column],
) -> DataFrame:
    """Both sources grouped to the link columns; the primary decides which rows exist."""
    a = primary.groupBy(*links).agg(*[m.alias(n) for n, m in primary_measures.items()])
    b = secondary.groupBy(*links).agg(*[m.alias(n) for n, m in secondary_measures.items()])
    return join_on(a, b, list(links), "left")


def augment_join(df: DataFrame, uploaded: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add the columns of an uploaded reference table; keys in it must be unique."""
    return df.join(uploaded, list(on), "left")


def map_lookup(df: DataFrame, key: str, mapping: DataFrame, to: str, default=None) -> DataFrame:
    """Add column `to` from a two-column mapping (key, value); unmapped keys get the default."""
    k, v = mapping.columns
    first = mapping.groupBy(F.col(k).alias("_k")).agg(F.min(v).alias("_v"))
    out = df.join(first, df[key] == first["_k"], "left")
    value = F.col("_v") if default is None else F.coalesce(F.col("_v"), F.lit(default))
    return out.withColumn(to, value).drop("_k", "_v")


def lookup_value(
    df: DataFrame, key: str, table: DataFrame, match: str, value: str, order: Sequence[str], to: str
) -> DataFrame:
    """Add `value` of the first row of `table` (in the declared order) whose `match` equals the key."""
    first = table.groupBy(F.col(match).alias("_k")).agg(
        F.min_by(F.col(value), F.struct(*order)).alias(to)
    )
    return df.join(first, df[key] == first["_k"], "left").drop("_k")


def join_asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str],
) -> DataFrame:
    """Each left row with the latest right row at or before it, per key.

    Both sides are stacked and shuffled once by key; a window finds the latest right row. The time lines of hot
    keys are cut into segments of about equally many rows (`segments`), each a task's work, and what earlier
    segments leave behind comes in through one row per (hot key, segment). Right rows that share key and time
    are resolved to the greatest values; a NULL key or time matches nothing.
    """
    keys = list(keys)
    # Hits are ordered by time and then by values, so the latest one is the greatest.
    hit = F.struct(F.col(right_ts).alias("at"), *[F.col(v) for v in values])
    known = right.dropna(subset=[*keys, right_ts]).select(*keys, F.col(right_ts).alias("_ts"), hit.alias("_hit"))
    rows = left.select(*keys, F.col(left_ts).alias("_ts"), F.struct(*left.columns).alias("_row"))
    cuts = cut_hot(rows.select(*keys, "_ts").unionByName(known.select(*keys, "_ts")), keys, "_ts")
    both = rows.withColumn("_hit", F.lit(None).cast(known.schema["_hit"].dataType)).unionByName(
        known.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType))
    )
    parts = keys
    if cuts:
        both, parts = cuts.on(both, "_ts"), [*keys, "_seg", "_share"]
    upto = W.partitionBy(*parts).orderBy("_ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    latest = both.withColumn("_latest", F.max("_hit").over(upto)).where(F.col("_row").isNotNull())
    if cuts:
        ends = cuts.on(known, "_ts").groupBy(*keys, "_seg").agg(F.max("_hit").alias("_end"))
        # At most two rows per shuffle partition: the hot keys' segments. An instant's own hits count for all its rows.
        line = join_on(cuts.numbered(), ends, [*keys, "_seg"], "left")
        ahead = W.partitionBy(*keys).orderBy("_seg")
        before = F.max("_end").over(ahead.rowsBetween(W.unboundedPreceding, -1))
        carried = F.when(F.col("_instant"), F.max("_end").over(ahead.rowsBetween(W.unboundedPreceding, 0))).otherwise(before)
        carry = line.select(*keys, "_seg", carried.alias("_carry"))
        latest = join_on(latest, F.broadcast(carry), [*keys, "_seg"], "left")
        timed = F.col("_ts").isNotNull()
        latest = latest.withColumn("_latest", F.when(timed, F.greatest("_latest", "_carry")))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col("_ts").isNotNull())
    found = F.when(whole, F.col("_latest"))
    return latest.select("_row", found.alias("_found")).select(
        "_row.*", F.col("_found.at").alias(right_ts), *[F.col(f"_found.{v}").alias(v) for v in values])


# Distinct keys up to which a sketch holds them all, so that what two sketches share is exact.
SKETCH_BITS = 14


def _key_type(kind: str) -> str:
    """The type under which keys are compared: like types as they are, whole numbers of any width alike."""
    return "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else kind


def discover_joins(tables: Mapping[str, DataFrame], name_of=lambda c: c.lower()) -> DataFrame:
    """Candidate joins between tables whose columns share a name.

    `name_of` maps a column to the name under which it is compared. A column is a candidate target if its
    non-null rows are all distinct there; the cardinality follows from the most rows per key on the source
    side. `inclusion` is the share of distinct source keys found in the target. Keys of unlike types are
    compared as text.

    Each column is grouped once, to its keys, which are written; one row of each tells rows, keys, most rows a
    key, least and greatest key, and a sketch of the keys. These rows decide most pairs: the target is not
    unique, the ranges lie apart, or both sketches hold all keys. Only for the others are keys joined.
    """
    pairs = [
        (s, sc, t, tc)
        for s, sdf in tables.items()
        for t, tdf in tables.items()
        if s != t
        for sc in sdf.columns
        for tc in tdf.columns
        if name_of(sc) == name_of(tc)
    ]
    if not pairs:
        raise ValueError("no two tables share a column name")
    columns = sorted({(s, sc) for s, sc, _, _ in pairs} | {(t, tc) for _, _, t, tc in pairs})
    kinds = {(t, c): _key_type(tables[t].schema[c].dataType.simpleString()) for t, c in columns}
    keyed = {
        (t, c): settled(tables[t].where(F.col(c).isNotNull()).groupBy(F.col(c).cast(kinds[t, c]).alias("k")).agg(F.count("*").alias("n")))
        for t, c in columns
    }
    told = []
    for i, column in enumerate(columns):
        hashed = F.xxhash64("k")
        told.append(keyed[column].agg(
            F.lit(i).alias("i"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.max("n").alias("most"),
            F.to_json(F.struct(F.min("k").alias("k"))).alias("least"), F.to_json(F.struct(F.max("k").alias("k"))).alias("greatest"),
            F.theta_sketch_agg(hashed, F.lit(SKETCH_BITS)).alias("sketch")))
    summary = settled(reduce(DataFrame.unionByName, told))

    spark = summary.sparkSession
    number = {c: i for i, c in enumerate(columns)}
    listed = spark.createDataFrame(
        [(p, number[s, sc], number[t, tc], s, sc, t, tc, kinds[s, sc] if kinds[s, sc] == kinds[t, tc] else "") for p, (s, sc, t, tc) in enumerate(pairs)],
        "pair int, si int, ti int, source_table string, source_column string, target_table string, target_column string, kind string")
    side = lambda tag: summary.select(*[F.col(c).alias(f"{tag}_{c}") for c in summary.columns])
    known = listed.join(side("s"), F.col("si") == F.col("s_i")).join(side("t"), F.col("ti") == F.col("t_i")).where("t_rows = t_keys")
    key = lambda c, kind: F.from_json(c, f"k {kind}")["k"]
    apart = F.lit(False)
    for kind in sorted(set(kinds.values())):
        beyond = (key("s_greatest", kind) < key("t_least", kind)) | (key("t_greatest", kind) < key("s_least", kind))
        apart = apart | ((F.col("kind") == kind) & F.coalesce(beyond, F.lit(False)))
    empty = (F.col("s_keys") == 0) | (F.col("t_keys") == 0)
    # A sketch holds every key of a column with fewer than 2**SKETCH_BITS of them.
    whole = (F.col("kind") != "") & (F.greatest("s_keys", "t_keys") < (1 << SKETCH_BITS))
    met = F.theta_sketch_estimate(F.theta_intersection("s_sketch", "t_sketch"))
    decided = settled(known.withColumn("shared", F.when(empty | apart, 0).when(whole, met).cast("bigint")).drop("s_sketch", "t_sketch"))

    joined = []
    for r in decided.where("shared IS NULL").select("pair", "si", "ti", "kind").collect():
        a, b = keyed[columns[r.si]].select("k"), keyed[columns[r.ti]].select("k")
        same = r.kind or "string"
        both = a.select(F.col("k").cast(same).alias("a")).join(b.select(F.col("k").cast(same).alias("b")), F.col("a") == F.col("b"))
        joined.append(both.agg(F.lit(r.pair).alias("of"), F.count_distinct("a").alias("met") if not r.kind else F.count("*").alias("met")))
    exact = reduce(DataFrame.unionByName, joined) if joined else spark.createDataFrame([], "of int, met long")
    return decided.join(exact, F.col("pair") == F.col("of"), "left").select(
        "source_table", "source_column", "target_table", "target_column",
        F.col("t_rows").alias("target_rows"), F.col("t_keys").alias("target_keys"), F.col("s_most").alias("max_rows_per_key"),
        F.when(F.col("s_most") == 1, "ONE_TO_ONE").otherwise("MANY_TO_ONE").alias("cardinality"),
        F.try_divide(F.coalesce("shared", "met").cast("double"), F.col("s_keys")).alias("inclusion"),
    )
