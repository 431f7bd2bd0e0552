"""Named sources: parquet tables with declared columns, SQL views, grouped views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, types as T


class Tables:
    """Parquet tables of one folder, read lazily: `Tables(spark, dir).lineitem`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def scan_table(
    spark: SparkSession, path: str, columns: Mapping[str, T.DataType | str] | None = None
) -> DataFrame:
    """Read a parquet table; with `columns`, keep only those, cast to the declared types."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the declared columns {missing}")
    return df.select(*[df[c].cast(t).alias(c) for c, t in columns.items()])


def sql_view(spark: SparkSession, name: str, sql: str, sources: Mapping[str, DataFrame]) -> DataFrame:
    """A raw query over named sources, usable as a table under `name`."""
    for alias, df in sources.items():
        df.createOrReplaceTempView(alias)
    view = spark.sql(sql)
    view.createOrReplaceTempView(name)
    return view


def agg_view(
    df: DataFrame, keys: Sequence[str | Column], measures: Mapping[str, Column], name: str | None = None
) -> DataFrame:
    """A saved grouped query that other queries can start from."""
    view = df.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])
    if name:
        view.createOrReplaceTempView(name)
    return view


def select_all_except(df: DataFrame, *names: str) -> DataFrame:
    """Every column but the named ones; an unknown name is an error, not a no-op."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.drop(*names)
