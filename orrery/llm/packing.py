"""Best-fit packing of documents into sequences by hierarchical residual merging.

Each text becomes its ids and an end id. Only longer ones are cut, into pieces of the full
length, the first of which may be shorter: full pieces are sequences by themselves and the first
piece is an item. Each partition packs its items best-fit, largest first. Nearly full bins are
emitted; underfull bins go on as items of the next round, in fewer partitions, until one is left
or a round merges next to nothing. A round is written before the next begins, a partition never
gets more than about ITEMS of them, and only counts reach the driver.

Null texts are empty and hold the end id alone. Equal rows are separate documents; ties are
settled by input order. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import crc32_ids, small_batches, text_of, written
from orrery.llm.encode import Encoder

LENGTH = 1024
END = 2
# Items of a partition in a round; room that a nearly full bin may leave.
ITEMS, SLACK = 50_000, 2
# A round that leaves more than this share of its items ends the merging.
STALL = 0.97
PIECES = "row long, doc_id long, n_tokens long, crcs array<long>"
BINS = "size int, rows array<long>, sizes array<int>, places array<long>, done boolean"


def tokenize(docs: DataFrame, tokenizer: str, length: int, end: int, keep_ids: bool) -> DataFrame:
    """A row a document: a number that is followed by free ones for its other pieces, and a crc each piece."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, row = Encoder(tokenizer), TaskContext.get().partitionId() << 40
        for b in batches:
            out = {"row": [], "n_tokens": [], "crcs": []} | ({"ids": []} if keep_ids else {})
            for text in b["text"]:
                ids = encoder.with_end(text_of(text), end)
                count = -(-len(ids) // length)
                first = len(ids) - length * (count - 1)
                cuts = [0, *range(first, len(ids) + 1, length)]
                out["row"].append(row)
                out["n_tokens"].append(len(ids))
                out["crcs"].append([crc32_ids(ids[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)])
                if keep_ids:
                    out["ids"].append(ids.astype("<u4").tobytes())
                row += count
            yield pd.DataFrame(out | {"doc_id": b["doc_id"].astype("Int64").array})

    return docs.select("doc_id", "text").mapInPandas(encode, PIECES + (", ids binary" if keep_ids else ""))


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: a bin with room r is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = length, len(bins)
            bins.append([i])
        left = room - size
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins


def merge_round(items: DataFrame, length: int) -> DataFrame:
    """Bins of the items of each partition; `done` marks those that are nearly full."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        b = pd.concat(parts, ignore_index=True)
        sizes, rows, inner = b["size"].to_numpy(), b["rows"].to_numpy(), b["sizes"].to_numpy()
        bins = best_fit(sizes, length)
        for at in range(0, len(bins), 5000):
            part = bins[at:at + 5000]
            full = [int(sizes[k].sum()) for k in part]
            lengths = [np.concatenate([inner[i] for i in k]) for k in part]
            yield pd.DataFrame({
                "size": np.array(full, np.int32), "rows": [np.concatenate([rows[i] for i in k]) for k in part],
                "sizes": lengths, "places": [np.cumsum(x, dtype=np.int64) - x for x in lengths],
                "done": [f >= length - SLACK for f in full],
            })

    return items.mapInPandas(pack, BINS)


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, items: int = ITEMS, keep_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids as little-endian binary) a piece."""
    spark = docs.sparkSession
    small_batches(spark)
    known = written(tokenize(docs, tokenizer, length, end, keep_ids), "pack-tokens")
    first = (F.col("n_tokens") - 1) % length + 1
    left = known.where(first < length).select(
        first.cast("int").alias("size"), F.array("row").alias("rows"), F.array(first.cast("int")).alias("sizes")
    )
    count, done = left.count(), []
    while count:
        parts = -(-count // items)
        bins = written(merge_round(left.repartition(parts), length), "pack-round")
        rest = bins.where("NOT done").count()
        if parts == 1 or rest > STALL * count:
            done.append(bins)
            break
        done.append(bins.where("done"))
        left, count = bins.where("NOT done").select("size", "rows", "sizes"), rest
    heads = None
    for bins in done:
        one = bins.select(
            F.col("rows")[0].alias("sequence"),
            F.explode(F.arrays_zip("rows", "places")).alias("m"),
        ).select(F.col("m.rows").alias("row"), "sequence", F.col("m.places").alias("place"))
        heads = one if heads is None else heads.unionByName(one)
    if heads is None:
        heads = spark.createDataFrame([], "row long, sequence long, place long")
    start = F.when(F.col("piece") == 0, 0).otherwise(F.col("first") + (F.col("piece") - 1) * length).cast("long")
    size = F.when(F.col("piece") == 0, F.col("first")).otherwise(length).cast("long")
    out = known.withColumn("first", first).join(heads, "row", "left") \
        .select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    whole = size == length
    return out.select(
        "doc_id", "piece", start.alias("start"), size.alias("length"), "ids_crc32",
        F.when(whole, F.col("row") + F.col("piece")).otherwise(F.col("sequence")).alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("place")).cast("long").alias("offset"),
        *([F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids")] if keep_ids else []),
    )
