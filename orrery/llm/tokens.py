"""Token-id shards: each block of documents is one compressed wavelet matrix.

`write_tokens` encodes texts in ascending doc_id order (range partitions, so no task holds all)
and writes one parquet file a shard. A row is a block: the documents' ids and lengths, and a
wavelet matrix of their tokens, each plane compressed. `read_documents` gets every id back,
`token_at`, `token_counts` and `occurrences` ask the matrix by access, rank and select without
decoding it.

A null text counts as empty and holds the end id alone. Equal doc_ids follow each other by their
text's hash; null ids come first. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orrery.llm.common import crc32_ids, small_batches, text_of
from orrery.llm.encode import Encoder
from orrery.llm.wavelet import WaveletMatrix
from orrery.session import fresh_path

END = 2
BLOCK_TOKENS = 1 << 17
FORMAT = "shard int, block int, doc_ids array<long>, lengths array<long>, tokens long, matrix binary"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = END, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the shards of `docs` (doc_id, text) below `path`. A block holds whole documents."""
    small_batches(docs.sparkSession)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, shard, block = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        bits = max(1, int(max(encoder.tokenizer.get_vocab_size() - 1, end)).bit_length())
        ids, doc_ids, size = [], [], 0

        def row():
            matrix = WaveletMatrix.build(np.concatenate(ids), bits).to_bytes()
            return pd.DataFrame({
                "shard": [shard], "block": [block], "doc_ids": [doc_ids], "lengths": [list(map(len, ids))],
                "tokens": [size], "matrix": [matrix],
            })

        for b in batches:
            for doc_id, text in zip(b["doc_id"].astype("Int64"), b["text"], strict=True):
                ids.append(encoder.with_end(text_of(text), end))
                doc_ids.append(None if doc_id is pd.NA else int(doc_id))
                size += len(ids[-1])
                if size >= block_tokens:
                    yield row()
                    ids, doc_ids, size, block = [], [], 0, block + 1
        if ids:
            yield row()

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")) \
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInPandas(shards, FORMAT).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORMAT).parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files."""
    small_batches(spark)
    fields = "shard int, block int, doc_id long, place long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids = WaveletMatrix.from_bytes(r.matrix).symbols()
                ends = np.cumsum(r.lengths)
                starts = ends - r.lengths
                parts = [ids[s:e] for s, e in zip(starts, ends, strict=True)]
                out = pd.DataFrame({
                    "shard": np.int32(r.shard), "block": np.int32(r.block), "doc_id": pd.array(list(r.doc_ids), "Int64"),
                    "place": starts, "n_tokens": ends - starts, "ids_crc32": [crc32_ids(p) for p in parts],
                })
                if with_ids:
                    out["ids"] = [p.astype(np.int64) for p in parts]
                yield out

    blocks = read_shards(spark, path)
    sizes = blocks.select("shard", "block", "tokens")
    # One row a shard meets in one task; blocks are summed inside their shard.
    totals = sizes.groupBy("shard").agg(F.sum("tokens").alias("all")).withColumn(
        "shard_start", F.sum("all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    )
    inside = F.sum("tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("inside", inside).join(totals, "shard").select(
        "shard", "block", (F.coalesce("shard_start", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("before")
    )
    found = blocks.mapInPandas(decode, fields + (", ids array<long>" if with_ids else "")).join(starts, ["shard", "block"])
    return found.select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )


def token_counts(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """How often each of the ids occurs, by rank on the matrices."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob in b["matrix"]:
                m = WaveletMatrix.from_bytes(blob)
                yield pd.DataFrame({"id": ids, "n": [m.count(i) for i in ids]})

    each = read_shards(spark, path).select("matrix").mapInPandas(count, "id long, n long")
    return each.groupBy("id").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id and place inside it of every occurrence of a token, by select on the matrices."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                places = WaveletMatrix.from_bytes(r.matrix).occurrences(token)
                ends = np.cumsum(r.lengths)
                doc = np.searchsorted(ends, places, side="right")
                ids = pd.array(list(r.doc_ids), "Int64")
                yield pd.DataFrame({"doc_id": ids[doc], "place": places - (ends - r.lengths)[doc]})

    return read_shards(spark, path).select("doc_ids", "lengths", "matrix").mapInPandas(find, "doc_id long, place long")


def token_at(spark: SparkSession, path: str, doc_id: int, places: list[int]) -> DataFrame:
    """The ids at some places of one document, by access; places outside it are left out."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ends, m = np.cumsum(r.lengths), WaveletMatrix.from_bytes(r.matrix)
                for k in np.flatnonzero(np.asarray(r.doc_ids, float) == doc_id):
                    inside = np.array([p for p in places if 0 <= p < r.lengths[k]], np.int64)
                    yield pd.DataFrame({"place": inside, "id": m.access(ends[k] - r.lengths[k] + inside).astype(np.int64)})

    one = read_shards(spark, path).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    return one.select("doc_ids", "lengths", "matrix").mapInPandas(get, "place long, id long")


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the texts as token shards in the shared folder and read the documents back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_documents(docs.sparkSession, path)
