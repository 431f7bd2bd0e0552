"""Where each named query and its SQL counterpart is recorded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orrery.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _plain_types(df: DataFrame) -> DataFrame:
    """Integers as long, floats as double, instants without zone: one shape for all results."""
    wanted = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        wanted.append(c)
    return df.select(*wanted)


def query(name: str, sql: str | None = None):
    """Record `fn(tables) -> DataFrame` under `name`, with the SQL it must agree with."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is recorded twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain_types(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep
