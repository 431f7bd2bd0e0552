"""Token counts by a two-tier lookup on the map side.

`frequent` goes once over all texts: every task keeps a summary of its most frequent pre-tokens (counts
less what bounded memory had to forget), and only these summaries, one row a task, are merged, as a
tree. The driver encodes the pre-tokens of the last one and broadcasts their numbers of tokens as a
compact table, whose size `ENTRIES` and `LONG` bound. `counted` then goes over the texts where they lie:
a pre-token is looked up in the table, a miss in the worker's own cache, and only what is in neither is
encoded. Pre-tokens are never shuffled. The table decides the speed alone, no result depends on it.

A null text counts as empty: no bytes, no tokens. Null and repeated doc_ids keep a row each. Texts of any
length are counted whole. An empty table gives no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import small_batches, text_of, written
from orrery.llm.encode import LONG, Encoder

# Pre-tokens of a summary and of the broadcast table, of at most LONG characters each; of a worker's cache.
ENTRIES, CACHE = 1 << 14, 400_000
FAN = 32
LIMIT = 2048
SUMMARY = "part long, kinds binary, keys array<string>, counts array<long>"


class Pieces:
    """cut(text) gives (kind, pre-tokens), or None where the tokenizer must see the whole text.

    Kinds keep apart the pre-tokens of plain texts and the chunks of others. A sentencepiece model has no
    pre-tokens that could be counted alone: its texts are always encoded whole.
    """

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cut, self.whole = (lambda text: None), (lambda text: len(model.encode(text)))
            return
        encoder = Encoder(path)
        self.known = (encoder.piece_ids, encoder.chunk_ids)
        self.encoder, self.width = encoder, encoder.dtype.itemsize

    def cut(self, text: str) -> tuple[int, list[str]] | None:
        parts = self.encoder.cut(text)
        return parts and (int(parts[0] is self.known[1]), parts[1])

    def whole(self, text: str) -> int:
        return len(self.encoder._whole(text)) // self.width

    def tokens(self, kind: int, piece: str) -> int:
        return len(self.known[kind].encode(piece)) // self.width


class Summary:
    """The most frequent keys of a stream in bounded memory: too many, and the first count left out is
    taken from all. Counts are short by total / ENTRIES at most, also after merges."""

    def __init__(self, entries: int):
        self.entries, self.counts = entries, Counter()

    def add(self, counts) -> None:
        self.counts.update(counts)
        if len(self.counts) > 8 * self.entries:
            self.cut()

    def cut(self) -> None:
        if len(self.counts) > self.entries:
            least = np.partition(np.fromiter(self.counts.values(), np.int64), -self.entries - 1)[-self.entries - 1]
            self.counts = Counter({k: c - int(least) for k, c in self.counts.items() if c > least})

    def row(self, part: int) -> pd.DataFrame:
        self.cut()
        found = sorted(self.counts.items(), key=lambda kc: (-kc[1], kc[0]))
        return pd.DataFrame({
            "part": [part], "kinds": [bytes(k for (k, _), _ in found)], "keys": [[s for (_, s), _ in found]],
            "counts": [[c for _, c in found]],
        })


def frequent(docs: DataFrame, tokenizer: str, entries: int = ENTRIES) -> list[tuple[int, str, int]]:
    """(kind, pre-token, tokens) of up to `entries` pre-tokens, the most frequent of all texts first."""
    small_batches(docs.sparkSession)

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, summary = Pieces(tokenizer), Summary(entries)
        for b in batches:
            found = (Counter(), Counter())
            for text in b["text"]:
                parts = pieces.cut(text_of(text))
                if parts:
                    found[parts[0]].update(parts[1])
            for kind, counts in enumerate(found):
                summary.add({(kind, s): c for s, c in counts.items() if len(s) <= LONG})
        yield summary.row(TaskContext.get().partitionId())

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        summary = Summary(entries)
        for r in group.itertuples(index=False):
            summary.add({(k, s): int(c) for k, s, c in zip(r.kinds, r.keys, r.counts, strict=True)})
        return summary.row(int(group["part"].iloc[0]) // FAN)

    found = written(docs.select("text").mapInPandas(summaries, SUMMARY), "pre-tokens")
    top = found.agg(F.max("part")).first()[0]
    while top:
        found, top = found.groupBy(F.expr(f"part div {FAN}")).applyInPandas(merged, SUMMARY), top // FAN
    pieces = Pieces(tokenizer)
    return [(k, s, pieces.tokens(k, s)) for r in found.collect() for k, s in zip(r.kinds, r["keys"], strict=True)]


def packed(table: list[tuple[int, str, int]]) -> tuple[bytes, bytes, bytes, bytes]:
    """The table in four byte strings: kinds, characters, their numbers and the numbers of tokens."""
    sizes = np.array([len(s) for _, s, _ in table], np.uint8).tobytes()
    return (bytes(k for k, _, _ in table), "".join(s for _, s, _ in table).encode("utf-8", "surrogatepass"), sizes,
            array.array("H", [n for _, _, n in table]).tobytes())


class Lengths(dict):
    """Numbers of tokens by pre-token: the broadcast table, behind it a cache of this worker's misses."""

    def __init__(self, pieces: Pieces, kind: int):
        super().__init__()
        self.pieces, self.kind, self.misses = pieces, kind, {}

    def __missing__(self, piece: str) -> int:
        n = self.misses.get(piece)
        if n is None:
            n = self.pieces.tokens(self.kind, piece)
            if len(piece) <= LONG:
                if len(self.misses) >= CACHE:
                    self.misses.clear()
                self.misses[piece] = n
        return n


def lookup(pieces: Pieces, table: tuple[bytes, bytes, bytes, bytes]) -> tuple[Lengths, Lengths]:
    """The table as one map a kind."""
    maps, text, at = (Lengths(pieces, 0), Lengths(pieces, 1)), table[1].decode("utf-8", "surrogatepass"), 0
    for kind, size, n in zip(table[0], table[2], array.array("H", table[3]), strict=True):
        maps[kind][text[at:at + size]] = n
        at += size
    return maps


def counted(docs: DataFrame, tokenizer: str, limit: int = LIMIT, entries: int = ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    table = spark.sparkContext.broadcast(packed(frequent(docs, tokenizer, entries)))

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(tokenizer)
        maps = lookup(pieces, table.value)
        for batch in texts:
            out = []
            for text in map(text_of, batch):
                parts = pieces.cut(text)
                out.append(sum(map(maps[parts[0]].__getitem__, parts[1])) if parts else pieces.whole(text))
            yield pd.Series(out, dtype="int64")

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    found = docs.select("doc_id", n_bytes.alias("n_bytes"), tokens("text").alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
