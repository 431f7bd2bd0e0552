"""Benchmark decontamination by Wu-Manber search over words.

Words are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. Patterns
are the windows of 13 consecutive words of the benchmark items; a shorter item is one window.
Windows of one length form one search: a shift table over blocks of two words says how far the
search may jump (an unknown block skips all places that would hold it), the last block's bucket
holds the patterns that may end there, and comparing all words settles it.

Null texts have no words and are not contaminated; an item without words matches nothing; equal
windows of several items count for each; repeated rows are judged each for itself. Extra
columns are left alone; an empty benchmark hits nothing, an empty table gives an empty one. Rows
of the benchmark with the same item_id are one item; a null item_id takes part in hits and is
not counted or listed.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.common import carried, put_back, small_batches, spans_of, text_of, written

WINDOW = 13
# Words of a block in the shift table.
BLOCK = 2
# Characters of benchmark text that one broadcast search table is made from.
TABLE_CHARS = 32_000_000
BENCH_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RESULT = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str) -> list[bytes]:
    """The words of the contract, as bytes; lower() of bytes changes A-Z alone."""
    return BENCH_WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class WuManber:
    """All patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple, set[str]]):
        self.length, self.patterns = length, patterns
        self.block = min(BLOCK, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list[tuple]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, length + 1):
                key = p[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.bucket[p[-self.block:]].append(p)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(start, pattern) of every occurrence."""
        shift, block, n, jump = self.shift, self.block, len(words), self.jump
        end = self.length
        while end <= n:
            key = tuple(words[end - block:end])
            step = shift.get(key, jump)
            if step:
                end += step
                continue
            start = end - self.length
            seen = tuple(words[start:end])
            if any(p == seen for p in self.bucket[key] if p[0] == seen[0]):
                yield start, seen
            end += 1


class Searcher:
    """A search for each pattern length of some items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        found: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text_of(text))
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                found[size][tuple(words[i:i + size])].add(item)
        self.searches = [WuManber(size, dict(p)) for size, p in sorted(found.items())]

    def judge(self, text: str) -> tuple[int, list[tuple[int, int]], list[str]]:
        words = words_of(text)
        covered, items = np.zeros(len(words), bool), set()
        for search in self.searches:
            for start, pattern in search.search(words):
                covered[start:start + search.length] = True
                items |= search.patterns[pattern]
        return len(words), list(spans_of(covered)), sorted(x for x in items if x is not None)


def _search(items: list[tuple[str | None, str]], spark, text: Column, window: int) -> Column:
    shared = spark.sparkContext.broadcast(items)

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(shared.value, window)
        for b in batches:
            rows = [searcher.judge(text_of(x)) for x in b]
            yield pd.DataFrame({
                "n_words": [r[0] for r in rows],
                "hits": [[{"start": s, "end": e} for s, e in r[1]] for r in rows],
                "items": [r[2] for r in rows],
            })

    return judged(text)


def _merge(a: Column, b: Column) -> Column:
    """Hits and items of two tables, hits still as separate spans."""
    return F.struct(
        a["n_words"].alias("n_words"), F.concat(a["hits"], b["hits"]).alias("hits"),
        F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
    )


def _covered(hits: Column) -> Column:
    """Words in any of the spans, which may overlap when they come from several tables."""
    step = lambda acc, h: F.struct(
        (acc["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["start"], acc["to"]))).cast("long").alias("n"),
        F.greatest(acc["to"], h["end"]).alias("to"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("to"))
    return F.aggregate(F.array_sort(hits), zero, step, lambda acc: acc["n"])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_chars: int = TABLE_CHARS) -> DataFrame:
    """`docs` with a column `_bench` (n_words, hits as word spans, items).

    The benchmark is dealt by item into parts of about `table_chars` characters, and each part
    is one broadcast table and one pass over the texts, so memory stays bounded for any benchmark.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # Repeated rows of a benchmark are one item each, so that the parts stay about equal.
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    parts = max(1, -(-chars // table_chars))
    names = docs.columns
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = [(r["item_id"], r["text"]) for r in mine.toLocalIterator()]
        docs = docs.withColumn("_bench_part", _search(rows, spark, F.col("text"), window))
        both = _merge(F.col("_bench"), F.col("_bench_part")) if part else F.col("_bench_part")
        docs = docs.select(*[F.col(f"`{c}`") for c in names], both.alias("_bench"))
        if part < parts - 1:  # a worker holds one table at a time
            docs = written(docs, "decontamination")
    return docs


def contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_chars: int = TABLE_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, hits (word spans), contaminated for every row of `docs`."""
    out = benchmark_hits(docs.select("doc_id", "text"), benchmark, window, table_chars)
    return out.select(
        "doc_id", F.col("_bench.n_words").alias("n_words"), _covered(F.col("_bench.hits")).alias("n_hit"),
        F.col("_bench.items").alias("item_ids"), F.col("_bench.hits").alias("hits"),
    ).withColumn("contaminated", contaminated(F.col("n_words"), F.col("n_hit")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their own columns only."""
    out = benchmark_hits(carried(docs, "text"), benchmark)
    bad = contaminated(F.col("_bench.n_words"), _covered(F.col("_bench.hits")))
    return put_back(out.where(~bad), docs.columns)
