"""Substring dedup: passages of 50 words that also start in a document with a smaller id.

Texts are cut so that equal windows meet. The anchor of a window is its 25-word part with the
smallest hash, so equal windows have equal anchors; consecutive windows with the same anchor make
a segment, and a segment goes to the shard of its anchor. Equal segments are one text of a shard,
with the smallest document that holds it. Only anchors with several different segments need a search.

A shard is a compressed FM-index over its segments' words: the Burrows-Wheeler transform as a
wavelet structure of bit planes with rank. Segments are streamed against it from their last word to
their first: a backward-search step prepends a word, and where no smaller document has the longer
match, the match gives up words at its right end (its parent among the LCP intervals). This gives
matching statistics, the longest match at each word in smaller documents; words where it
reaches 50 start a reported interval. A shard whose anchors hold more than SHARD_WORDS words is
indexed in blocks of that many, one after another.

A null text has no words. A null doc_id is smaller than none and has none smaller: such rows stay
whole. Rows with equal ids do not clear each other. Extra columns are not read; an empty table
gives no rows. Texts are handled whole, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import WORD, small_batches, spans_of, text_of, tidy_shuffles, written
from orrery.llm.jaccard import WordHashes, mixed
from orrery.llm.wavelet import WaveletMatrix

WINDOW, ANCHOR = 50, 25
SHARD_WORDS = 400_000
RANDOM = np.random.default_rng(50_25)
TIMES = (RANDOM.integers(0, 1 << 63, ANCHOR, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
BASES = [int(x) | 1 for x in RANDOM.integers(1 << 40, 1 << 62, 2)]
SEGMENTS = "doc_id long, tk long, start int, windows int, anchor long, s1 long, s2 long"


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), base, np.uint64))])


def segments(words: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, windows, anchor and two content hashes of each segment of a text's word hashes."""
    n = words.size - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    size = words.size - ANCHOR + 1
    h = np.zeros(size, np.uint64)
    for k in range(ANCHOR):
        h += words[k:k + size] * TIMES[k]
    h = mixed(h)
    place = np.lib.stride_tricks.sliding_window_view(h, WINDOW - ANCHOR + 1).argmin(1) + np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    windows = np.diff(np.append(first, n))
    end = first + windows + WINDOW - 1
    keys = []
    for base, w in zip(BASES, (words, mixed(words)), strict=True):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * _powers(base, words.size), dtype=np.uint64)])
        back = _powers(pow(base, -1, 1 << 64), words.size)[first]
        keys.append(mixed((total[end] - total[first]) * back + windows.astype(np.uint64)).view(np.int64))
    return first, windows, h[place[first]].view(np.int64), *keys


def _hashed(text: str, known: WordHashes) -> np.ndarray:
    words = WORD.findall(text)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: equal rows have equal results."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))


def cut(docs: DataFrame) -> DataFrame:
    """All segments of all texts that have an id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            found = [segments(_hashed(text_of(text), known)) for text in b["text"]]
            count = [x[0].size for x in found]
            start, windows, anchor, s1, s2 = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pd.DataFrame({
                "doc_id": np.repeat(b["doc_id"].to_numpy(np.int64), count), "tk": np.repeat(b["tk"].to_numpy(np.int64), count),
                "start": start.astype(np.int32), "windows": windows.astype(np.int32), "anchor": anchor, "s1": s1, "s2": s2,
            })

    return rows_of(docs.where("doc_id IS NOT NULL AND text IS NOT NULL")).mapInPandas(run, SEGMENTS)


class SparseMin:
    """Smallest entry of any range, by tables of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, step = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))
        self.table = np.full((len(self.levels), len(values)), np.iinfo(values.dtype).max, values.dtype)
        for k, v in enumerate(self.levels):
            self.table[k, :len(v)] = v

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo).astype(float))[1] - 1
        return np.minimum(self.table[k, lo], self.table[k, hi - (1 << k)])

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which all entries up to `at` reach `least`, less one; stops before an entry below."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            start = at - (1 << k) + 1
            go = start >= 0
            go[go] = self.table[k, start[go]] >= least[go]
            at[go] -= 1 << k
        return at

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from `at` on whose entry is below `least`."""
        at, n = at.copy(), self.table.shape[1]
        for k in range(len(self.levels) - 1, -1, -1):
            go = at + (1 << k) <= n
            go[go] = self.table[k, at[go]] >= least[go]
            at[go] += 1 << k
        return at


class FMIndex:
    """Backward search over words of texts, each of which belongs to a document."""

    def __init__(self, texts: list[np.ndarray], docs: np.ndarray):
        self.words = np.unique(np.concatenate(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        n = int(sizes.sum()) + len(texts)
        ends = np.cumsum(sizes + 1) - 1  # places of separators
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[inside] = np.searchsorted(self.words, np.concatenate(texts)) + 1
        # Separators differ from each other, so that no match reaches across one.
        rank = symbols + len(texts)
        rank[ends] = np.arange(len(texts))
        ranks = [rank]
        step = 1
        while True:
            rank = ranks[-1]
            after = np.full(n, -1, np.int64)
            after[:-step] = rank[step:]
            key = rank * (int(after.max()) + 2) + after + 1
            _, rank = np.unique(key, return_inverse=True)
            ranks.append(rank)
            step *= 2
            if int(rank.max()) == n - 1 or step > n:
                break
        order = np.argsort(ranks[-1], kind="stable")
        common = np.zeros(n - 1, np.int64)
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            fit = (a < n) & (b < n)
            fit[fit] = ranks[k][a[fit]] == ranks[k][b[fit]]
            common[fit] += 1 << k
            a[fit] += 1 << k
            b[fit] += 1 << k
        self.size = n
        # Entry j: words shared by the suffixes j - 1 and j; -1 at both ends.
        self.common = SparseMin(np.concatenate([[-1], common, [-1]]).astype(np.int32))
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        self.least = SparseMin(docs[owner[order]])
        last = np.where(order > 0, symbols[order - 1], 0)
        self.bwt = WaveletMatrix.build(last, max(1, int(len(self.words)).bit_length()))
        every = np.arange(len(self.words) + 1)
        self.first = self.bwt.first(every)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(every)))])[:-1]

    def symbols_of(self, words: np.ndarray) -> np.ndarray:
        """Words as symbols; -1 for one that is not in the index."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at + 1, -1)

    def prepend(self, symbol, lo, hi):
        l, h = self.bwt._walk(symbol, lo, hi)
        shift = self.before[symbol] - self.first[symbol]
        return l + shift, h + shift

    def matches(self, texts: list[np.ndarray], docs: np.ndarray) -> list[np.ndarray]:
        """Matching statistics: for each word of each text, the longest match from it on in a smaller document."""
        count = len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        width = int(sizes.max())
        grid = np.full((count, width), -1, np.int64)
        row = np.repeat(np.arange(count), sizes)
        col = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(width - sizes, sizes)
        grid[row, col] = self.symbols_of(np.concatenate(texts))
        out = np.zeros((count, width), np.int32)
        lo, hi, length = np.zeros(count, np.int64), np.full(count, self.size, np.int64), np.zeros(count, np.int64)
        for c in range(width - 1, -1, -1):
            todo = np.flatnonzero(width - sizes <= c)
            gone = grid[todo, c] < 0
            lo[todo[gone]], hi[todo[gone]], length[todo[gone]] = 0, self.size, 0
            todo = todo[~gone]
            while todo.size:
                l, h = self.prepend(grid[todo, c], lo[todo], hi[todo])
                good = l < h
                good[good] = self.least.between(l[good], h[good]) < docs[todo[good]]
                done = todo[good]
                lo[done], hi[done] = l[good], h[good]
                length[done] += 1
                todo = todo[~good]
                todo = todo[length[todo] > 0]  # an empty match cannot give up words
                if todo.size:
                    depth = np.maximum(self.common.table[0, lo[todo]], self.common.table[0, hi[todo]]).astype(np.int64)
                    depth = np.maximum(depth, 0)
                    lo[todo] = self.common.left(lo[todo], depth)
                    hi[todo] = self.common.right(hi[todo], depth)
                    root = depth == 0
                    lo[todo[root]], hi[todo[root]] = 0, self.size
                    length[todo] = depth
            out[:, c] = length
            out[width - sizes > c, c] = 0
        return [out[i, width - s:] for i, s in enumerate(sizes)]


def search_shard(pdf: pd.DataFrame, shard_words: int = SHARD_WORDS) -> pd.DataFrame:
    """Reported intervals of the segments of a shard, as word places from the segment's start."""
    known = WordHashes()
    pdf = pdf.sort_values(["doc_id", "s1", "s2"], ignore_index=True)
    texts = [_hashed(t, known) for t in pdf["words"]]
    docs = np.unique(pdf["doc_id"], return_inverse=True)[1].astype(np.int32)
    # A segment is asked for only if a smaller document has its anchor.
    ask = (pdf["doc_id"] > pdf.groupby("anchor")["doc_id"].transform("min")).to_numpy()
    hit = [np.zeros(len(t), bool) for t in texts]
    sizes, at = np.array([len(t) + 1 for t in texts]), 0
    while at < len(texts):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), shard_words, "right")))
        asked = np.flatnonzero(ask & (docs > docs[at]))
        if asked.size:
            index = FMIndex(texts[at:end], docs[at:end])
            for part in np.array_split(asked, max(1, asked.size // 20_000)):
                for i, m in zip(part, index.matches([texts[k] for k in part], docs[part]), strict=True):
                    for s in np.flatnonzero(m >= WINDOW):
                        hit[i][s:s + WINDOW] = True
        at = end
    some = [i for i, h in enumerate(hit) if h.any()]
    return pd.DataFrame({
        "s1": pdf["s1"].to_numpy()[some], "s2": pdf["s2"].to_numpy()[some],
        "spans": pd.Series([[{"start": s, "end": e} for s, e in spans_of(hit[i])] for i in some], dtype=object),
    })


def shared_spans(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, tk, spans): for each row with any, the word ranges that smaller documents also have."""
    spark = docs.sparkSession
    small_batches(spark)
    tidy_shuffles(spark)
    all_cut = written(cut(docs), "segments")
    distinct = all_cut.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.min("anchor").alias("anchor")
    )
    distinct = written(distinct, "texts")
    # Segments are asked for where their anchor has others, of different documents.
    anchors = distinct.groupBy("anchor").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo < hi")
    shared = distinct.join(anchors, "anchor", "left").withColumn("search", F.col("lo").isNotNull()) \
        .where("search OR last > least").select("s1", "s2", "least", "search")
    rows = all_cut.join(shared, ["s1", "s2"]).withColumn("copy", F.col("doc_id") > F.col("least")).where("copy OR search")
    rows = written(rows.drop("least"), "shared")
    asked = rows.where("search AND NOT copy")
    total = asked.agg(F.coalesce(F.sum(F.col("windows") + WINDOW), F.lit(0))).head()[0]
    shards = max(1, -(-total // shard_words))
    wanted = asked.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "windows", "anchor", "s1", "s2")).alias("cuts"))

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {"doc_id": [], "anchor": [], "s1": [], "s2": [], "words": []}
            for r in b.itertuples(index=False):
                words = WORD.findall(r.text)
                out["doc_id"] += [r.doc_id] * len(r.cuts)
                for k in ("anchor", "s1", "s2"):
                    out[k] += [c[k] for c in r.cuts]
                out["words"] += [" ".join(words[c["start"]:c["start"] + c["windows"] + WINDOW - 1]) for c in r.cuts]
            yield pd.DataFrame(out)

    # Rows with equal id and text are one source of the segment's words.
    parts = rows_of(docs).join(wanted.hint("merge"), ["doc_id", "tk"]).select("doc_id", "text", "cuts") \
        .mapInPandas(texts, "doc_id long, anchor long, s1 long, s2 long, words string")
    found = parts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(
        lambda pdf: search_shard(pdf.drop_duplicates(["s1", "s2"]), shard_words),
        "s1 long, s2 long, spans array<struct<start:int,end:int>>",
    )
    found = written(found, "found")
    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("windows") + (WINDOW - 1)).alias("end")))
    moved = F.transform("spans", lambda s: F.struct(
        (s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")
    ))
    spans = rows.where("copy").select("doc_id", "tk", whole.alias("spans")).unionAll(
        asked.join(found, ["s1", "s2"]).select("doc_id", "tk", moved.alias("spans"))
    )
    return spans.groupBy("doc_id", "tk").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def dedup(docs: DataFrame, shard_words: int = SHARD_WORDS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text, and removed spans) of every row of `docs`."""
    spans = written(shared_spans(docs, shard_words), "spans")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for text, cuts in zip(b["text"], b["spans"], strict=True):
                words = WORD.findall(text_of(text))
                gone = np.zeros(len(words), bool)
                for c in cuts if cuts is not None else ():
                    gone[c["start"]:c["end"]] = True
                kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g) if gone.any() else " ".join(words)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
                out["kept"].append(kept)
            if not with_text:
                del out["kept"]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").array} | out)

    rows = rows_of(docs).join(spans.hint("merge"), ["doc_id", "tk"], "left").select("doc_id", "text", "spans")
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return rows.mapInPandas(keep, fields + (", kept string" if with_text else ""))
