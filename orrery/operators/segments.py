"""Time lines of hot keys, cut by counted quantiles into segments that hold about equally many rows.

Keys with more rows than an average shuffle partition are hot; there are fewer of them than partitions, whatever
the data. Only their time lines are cut. An instant that holds a share of its own becomes a segment that is
known by its one time, so that its rows need no order and may lie in any task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from orrery.functions.search import blocks, place
from orrery.operators.keys import share_of


@dataclass(frozen=True)
class Segments:
    """The hot keys' segments: one row a key with `_cuts` (microseconds, ascending) and `_instants` (segment numbers).

    Segment i holds the times from cut i-1 up to before cut i. Keys that are not listed have segment 0 alone.
    """

    keys: tuple[str, ...]
    table: DataFrame

    def on(self, df: DataFrame, ts: str) -> DataFrame:
        """`df` with `_seg`, `_instant` and `_share`. Rows of an instant, and of a hot key without a time, are shared
        out over tasks, equal ones too; all others have share 0."""
        hot = F.broadcast(self.table.select(*[F.col(k).alias(f"_hot_{k}") for k in self.keys], "_blocks", "_instants", "_share_of"))
        met = df.join(hot, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in self.keys]), "left")
        at = micros(F.col(ts))
        seg = F.when(F.col("_blocks").isNotNull() & at.isNotNull(), place(at, F.col("_blocks"), upto=True)).otherwise(0)
        met = met.withColumn("_seg", seg).withColumn("_instant", F.coalesce(F.array_contains("_instants", F.col("_seg")), F.lit(False)) & at.isNotNull())
        spread = F.col("_instant") | (F.col("_blocks").isNotNull() & at.isNull())
        return met.withColumn("_share", F.when(spread, share_of(df, F.col("_share_of"))).otherwise(0)).drop("_blocks", "_instants", "_share_of", *[f"_hot_{k}" for k in self.keys])

    def numbered(self) -> DataFrame:
        """One row per hot key and segment: keys, `_seg`, `_instant`."""
        every = F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_seg")
        return self.table.select(*self.keys, "_instants", every).withColumn("_instant", F.array_contains("_instants", F.col("_seg"))).drop("_instants")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def cut_hot(times: DataFrame, keys: Sequence[str], ts: str) -> Segments | None:
    """The segments of the hot keys of `times` (keys, ts), or None where no key is hot.

    One job counts rows a key and brings back at most as many keys as there are shuffle partitions; where some
    are hot, a second one reads the quantiles of their times.
    """
    spark, keys = times.sparkSession, list(keys)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seen = Observation()
    counted = times.select(*keys).observe(seen, F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count("*").alias("_n"))
    top = counted.orderBy(F.desc("_n")).limit(parts).collect()
    total = seen.get["n"] if top else 0
    share = {tuple(r[k] for k in keys): -(-r["_n"] * parts // total) for r in top if r["_n"] * parts > total and total >= parts}
    if not share:
        return None
    schema = times.select(*keys).schema
    hot = spark.createDataFrame(list(share), schema)
    marks = [F.lit(i / parts) for i in range(1, parts)]
    of_hot = times.join(F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])),
                        reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]))
    quantiles = of_hot.groupBy(*keys).agg(F.percentile_approx(micros(F.col(ts)), F.array(*marks), 100 * parts).alias("_q")).collect()
    rows = []
    for r in quantiles:
        key = tuple(r[k] for k in keys)
        n = min(parts, 2 * share[key])
        picked = [r["_q"][parts * i // n - 1] for i in range(1, n)] if r["_q"] else []
        held = {c for c, d in zip(picked, picked[1:]) if c == d}
        cuts = sorted({*picked, *(c + 1 for c in held)})
        rows.append((*key, cuts, [cuts.index(c) + 1 for c in sorted(held)], parts))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    table = spark.createDataFrame(rows, f"{fields}, _cuts array<long>, _instants array<int>, _share_of int")
    return Segments(tuple(keys), table.withColumn("_blocks", blocks(F.col("_cuts"))))
