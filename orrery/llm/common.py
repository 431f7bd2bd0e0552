"""What several operators of this package share: batches, words, written tables."""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.session import fresh_path

# ASCII white space ends a word, nothing else does.
SPACE = "\x20\x09-\x0D"
WORD = re.compile(f"[^{SPACE}]+")
# Rows of an Arrow batch: texts may be long, so batches hold few of them.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Python workers get few texts at a time, so that long ones fit in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def tidy_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when a query that wrote them ends, where operators write one round after another."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame after a round trip through the shared folder: lineage ends, values stay fixed."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(df: DataFrame, *names: str) -> DataFrame:
    """Some columns of `df` beside its whole rows as one struct, so that no column of the caller meets a helper's name."""
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    return df.select(*names, whole.alias("_row"))


def put_back(df: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The rows that `carried` set aside, under their own names, with some columns changed."""
    changed = changed or {}
    return df.select(*[(changed[c] if c in changed else F.col(f"_row.c{i}")).alias(c) for i, c in enumerate(columns)])


def per_worker(name: str, key, make):
    """What `make` makes, once for each key in a Python worker that goes on to further tasks; the last key's only."""
    kept = sys.modules.setdefault("_orrery_worker", types.ModuleType("_orrery_worker")).__dict__
    if kept.get(name, (None,))[0] != key:
        kept[name] = key, make()
    return kept[name][1]


def built_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with more columns, as a generator's output: filters on them stay above it, so that heavy
    expressions are evaluated once a row and are never written out inside each other's lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def text_of(value) -> str:
    """Null and NaN as the empty text."""
    return value if isinstance(value, str) else ""


def flat(parts: Iterable[np.ndarray], dtype) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def spans_of(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of true entries as (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)
