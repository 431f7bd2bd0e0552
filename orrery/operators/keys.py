"""Conditions of joins: key pairs, and equally named columns where NULL equals NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def equal_pairs(a: DataFrame, b: DataFrame, on: Sequence[tuple[str, str]]) -> list[Column]:
    """Equalities of key pairs. Whole numbers of unlike width are widened; like types are
    left alone, so that a partitioning both sides already have is used."""
    whole = ("tinyint", "smallint", "int", "bigint")
    out = []
    for x, y in on:
        tx, ty = a.schema[x].dataType.simpleString(), b.schema[y].dataType.simpleString()
        wide = tx != ty and tx in whole and ty in whole
        out.append(a[x].cast("bigint") == b[y].cast("bigint") if wide else a[x] == b[y])
    return out


def share_of(df: DataFrame, n: Column) -> Column:
    """A number below n for each row, which spreads equal rows too: the reading task's number counts besides the
    row's hash. Unlike a random number it is the same when a lost task runs again."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*hashed) + F.spark_partition_id(), n).cast("int")


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join frames, also of one lineage, on columns both have; keeps the keys of `a` once.

    With no keys, `b` has one row and is put beside each row of `a` as scalars.
    """
    extra = [c for c in b.columns if c not in keys]
    if not keys:
        return beside(a, b)
    right = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *extra)
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(right, cond, how).drop(*[f"__{k}" for k in keys])


def beside_group(rows: DataFrame, table: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Each row beside its group's one row of `table`, in which the column `size` counts the group's rows.

    Shuffled by their keys, the rows of a large group would all lie in one task. Groups with more rows than an average
    shuffle partition are fewer than the partitions, whatever the data: their rows stay where they are and meet a
    broadcast table of at most two rows a partition. Only the other groups' rows are left to Spark's choice of join. With
    some of both kinds `rows` is read twice. `table` is read more than once; it should be settled.
    """
    if not keys:
        return beside(rows, table)
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups, total = table.agg(F.count("*"), F.sum(size)).first()
    if groups <= 2 * parts:
        return join_on(rows, F.broadcast(table), keys)
    is_hot = F.col(size) * parts > total
    hot = table.where(is_hot)
    if hot.isEmpty():
        return join_on(rows, table, keys)
    others = join_on(rows, F.broadcast(hot.select(*keys)), keys, "left_anti")
    return join_on(rows, F.broadcast(hot), keys).unionByName(join_on(others, table.where(~is_hot), keys))


def beside(a: DataFrame, one: DataFrame) -> DataFrame:
    """Every column of a one-row frame on each row of `a`, through a single scalar subquery.

    A frame with more than one row fails at run time instead of multiplying rows.
    """
    row = one.select(F.struct(*one.columns)).scalar()
    return a.select("*", *[row.getField(c).alias(c) for c in one.columns])
