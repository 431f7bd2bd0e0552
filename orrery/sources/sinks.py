"""Written rollups: partitioned by their date bucket, refreshed partition by partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_rollup(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Materialise a grouped frame as parquet.

    Rows are first brought together by partition value, so that each partition gets few
    files; at run time Spark splits a value that is too large for one task.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def refresh_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace just the partitions that occur in `df`; the others stay as they are."""
    (
        df.hint("rebalance", *[F.col(c) for c in partition_by])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def changed_partitions(base: DataFrame, changes: DataFrame, date: str) -> DataFrame:
    """Base rows of the dates that occur among the changed rows."""
    days = changes.select(F.to_date(date).alias("_day")).distinct()
    return base.join(days, F.to_date(base[date]) == days["_day"], "left_semi")
