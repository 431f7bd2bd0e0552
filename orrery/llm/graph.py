"""Connected components of a large graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b) of longs; the root is the smallest node it reaches.

    Nothing but counts reaches the driver; each round is written to the shared folder.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = written(now, "edges")
    mark = _mark(now)
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionAll(down.select("u", "m")).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select("v", "v").distinct())
