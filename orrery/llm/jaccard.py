"""Near copies by a MinHash LSH forest and exact verification of word-shingle Jaccard similarity.

Words end at ASCII white space and stay as they are; a shingle is five consecutive words, and a
text of one to four words is one shingle. Each text has a label in each of TREES prefix tries: one
byte of LEVELS MinHash values. Matched prefixes are shortened from the whole label until a pair at the
threshold shares one in some trie with RECALL probability. In each sorted trie, texts under one
node of that depth are linked to its first text as candidates; this joins all of a bucket without
making its pairs. Connected candidates are then compared exactly, all with all, in
blocks of bounded size that give one row a text: its links, and its class inside the block.

One row a document comes out: `class_id` is the smallest doc_id of its class (documents joined by
links), `n_links` counts the other documents whose similarity reaches the threshold. Equal texts
are one text with a number of copies. Null and empty texts have no shingle, no links, and a class
of their own. Repeated rows count as copies of each other; a null doc_id is ignored by `class_id`
unless its class has no other. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from orrery.llm.common import WORD, carried, put_back, small_batches, text_of, tidy_shuffles, written
from orrery.llm.graph import components

WORDS = 5
# The threshold as a fraction: 4/5.
ABOVE, BELOW = 4, 5
TREES, LEVELS = 64, 8
RECALL = 0.9999
# Shingles (and 256 a text besides) of a block of texts in the exact comparison.
BLOCK = 1 << 18
CACHE = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)
RANDOM = np.random.default_rng(20_260)
TIMES = (RANDOM.integers(0, 1 << 63, WORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
SCALE = (RANDOM.integers(0, 1 << 31, TREES * LEVELS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
SHIFT = RANDOM.integers(0, 1 << 32, TREES * LEVELS, dtype=np.uint32)


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = np.array([hashes[w] for w in WORD.findall(text)], np.uint64)
    if not words.size:
        return words
    if words.size < WORDS:
        words = np.concatenate([words, np.full(WORDS - words.size, MIX) * np.uint64(words.size)])
    n = words.size - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += words[k:k + n] * TIMES[k]
    return np.unique(mixed(total))


def labels(found: np.ndarray) -> np.ndarray:
    """A label for each tree: the trie path as a long, one byte a level."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * LEVELS, 0xFFFFFFFF, np.uint32)
    for at in range(0, x.size, 128):
        np.minimum(least, (x[at:at + 128, None] * SCALE + SHIFT).min(0), out=least)
    path = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    return np.ascontiguousarray(path).view(">i8").astype(np.int64)


def depth(similarity: float, recall: float = RECALL, trees: int = TREES, levels: int = LEVELS) -> int:
    """The longest prefix at which a pair of this similarity meets in some tree often enough."""
    for d in range(levels, 0, -1):
        if 1 - (1 - similarity ** d) ** trees >= recall:
            return d
    return 1


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a 128-bit key of the text, number of shingles and labels of every row."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(text_of(x), hashes) for x in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64").array, "k1": b["k1"], "k2": b["k2"], "n": [len(s) for s in sets],
                "labels": [labels(s) if s.size else None for s in sets],
            })

    return keyed(docs).mapInPandas(sign, "doc_id long, k1 long, k2 long, n long, labels array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def candidate_edges(texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each text and the first one under its node of a sorted trie, at the wanted depth."""
    cut = 8 * (LEVELS - depth(similarity))
    rows = texts.select("text_id", F.posexplode("labels").alias("tree", "label")) \
        .withColumn("prefix", F.shiftrightunsigned("label", cut))
    trie = Window.partitionBy("tree", "prefix").orderBy("text_id")
    return rows.select(F.col("text_id").alias("a"), F.first("text_id").over(trie).alias("b")).where("a <> b")


def shared_counts(texts: list[np.ndarray], first: int, same: bool) -> np.ndarray:
    """Shingles that each text of the first block shares with each of the second.

    `texts` are the first block's `first` texts and then the second's (none if both are the same).
    Frequent shingles are compared as bits of a row, rare ones by their lists.
    """
    count = len(texts)
    owner = np.repeat(np.arange(count), [len(t) for t in texts])
    _, code, freq = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    width = first if same else count - first
    out = np.zeros((first, width), np.int64)
    many = freq >= max(2, count // 16)
    rank = np.cumsum(many) - 1
    bits = np.zeros((count, -(-int(many.sum()) // 64) * 64 + 64), bool)
    own, c = owner[many[code]], code[many[code]]
    bits[own, rank[c]] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    other = packed[:first] if same else packed[first:]
    for i in range(first):
        out[i] = np.bitwise_count(other & packed[i]).sum(1, dtype=np.int64)
    few = (freq >= 2)[code] & ~many[code]
    own, c = owner[few], code[few]
    order = np.argsort(c, kind="stable")
    own, c = own[order], c[order]
    left = np.ones(len(own), bool) if same else own < first
    right = np.ones(len(own), bool) if same else ~left
    la, lc, ra, rc = own[left], c[left], own[right] - (0 if same else first), c[right]
    lo, hi = np.searchsorted(rc, lc, "left"), np.searchsorted(rc, lc, "right")
    sizes = hi - lo
    for at in range(0, len(la), 50_000):
        s = sizes[at:at + 50_000]
        total = int(s.sum())
        if total:
            place = np.arange(total) - np.repeat(np.cumsum(s) - s, s) + np.repeat(lo[at:at + 50_000], s)
            np.add.at(out, (np.repeat(la[at:at + 50_000], s), ra[place]), 1)
    return out


def verify(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of the texts of one pair of blocks: other documents they reach, and the smallest text of their class."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    pdf = pdf.drop_duplicates("text_id")
    one, two = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
    same = i == j
    both = one if same else pd.concat([one, two])
    sets = [np.frombuffer(x, np.uint64) for x in both["shingles"]]
    first, n = len(one), np.array([len(s) for s in sets], np.int64)
    if not first or (not same and not len(two)):
        return pd.DataFrame({"text_id": [], "least": [], "links": []}).astype("int64")
    shared = shared_counts(sets, first, same)
    n_two = n if same else n[first:]
    linked = shared * (ABOVE + BELOW) >= ABOVE * (n[:first, None] + n_two[None, :])
    if same:
        np.fill_diagonal(linked, False)
    ids = both["text_id"].to_numpy()
    copies = both["copies"].to_numpy()
    links = np.zeros(len(both), np.int64)
    links[:first] += linked @ (copies if same else copies[first:])
    if not same:
        links[first:] += linked.T @ copies[:first]
    least = ids.copy()
    a, b = np.nonzero(linked)
    b = b if same else b + first
    while a.size:  # the smallest text spreads along the links
        now = least.copy()
        np.minimum.at(now, a, least[b])
        np.minimum.at(now, b, least[a])
        if (now == least).all():
            break
        least = now
    return pd.DataFrame({"text_id": ids, "least": least, "links": links})


def near_copies(docs: DataFrame, similarity: float = ABOVE / BELOW) -> DataFrame:
    """doc_id, class_id, n_links for every row of `docs`."""
    return _classes(docs, similarity).select("doc_id", "class_id", "n_links")


def keep_first(docs: DataFrame, similarity: float = ABOVE / BELOW) -> DataFrame:
    """One row of each class: the one with the smallest doc_id (any of its repeats), all columns kept.

    Rows without shingles stay, and so do those of a class in which no row has a doc_id.
    """
    classes = written(_classes(docs, similarity), "near-copies")
    kept = classes.where("doc_id <=> class_id").select("doc_id", "k1", "k2", "n")
    rows, kept = kept.where("n > 0 AND doc_id IS NOT NULL").count(), kept.distinct()
    repeats = rows - kept.where("n > 0 AND doc_id IS NOT NULL").count()
    kept = kept.select(*[F.col(c).alias(f"_near_{c}") for c in kept.columns])
    text = F.coalesce("text", F.lit(""))
    out = carried(docs, "doc_id", "text").withColumns({"_near_1": F.xxhash64(text), "_near_2": F.xxhash64(F.lit(1), text)}).join(kept.hint("merge"), F.expr(
        "doc_id <=> _near_doc_id AND _near_1 = _near_k1 AND _near_2 = _near_k2"
    ))
    if repeats:
        same = Window.partitionBy("_near_doc_id", "_near_1", "_near_2").orderBy("_near_n")
        out = out.withColumn("_near_row", F.row_number().over(same)) \
            .where("_near_row = 1 OR _near_n = 0 OR doc_id IS NULL")
    return put_back(out, docs.columns)


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    tidy_shuffles(spark)
    signed = written(signatures(docs.select("doc_id", "text")), "signatures")
    texts = signed.where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.first("labels").alias("labels")
    ).withColumn("text_id", F.monotonically_increasing_id())
    texts = written(texts, "texts")
    near = written(components(candidate_edges(texts, similarity)), "candidates")

    # Texts of a candidate class in blocks of bounded size.
    inside = Window.partitionBy("root").orderBy("text_id")
    block = F.floor((F.sum(F.col("n") + 256).over(inside) - F.col("n") - 256) / BLOCK).cast("int")
    placed = written(
        near.join(texts.drop("labels"), near["node"] == texts["text_id"]).drop("node").withColumn("block", block), "blocks"
    )
    counted = placed.groupBy("root").agg((F.max("block") + 1).alias("blocks"))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            b["shingles"] = [shingles(text_of(x), known).tobytes() for x in b["text"]]
            yield b.drop(columns="text")

    wanted = placed.withColumnRenamed("keeper", "doc_id").alias("p")
    rows = keyed(docs).alias("d").join(
        wanted.hint("merge"), F.expr("d.k1 = p.k1 AND d.k2 = p.k2 AND d.doc_id <=> p.doc_id")
    ).select("d.text", "p.text_id", "p.root", "p.block", "p.copies")
    rows = rows.mapInPandas(hashes, "text_id long, root long, block int, copies long, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = rows.join(counted, "root").withColumn("other", other).select(
        "text_id", "root", "block", "copies", "shingles",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )
    checked = written(
        pairs.groupBy("root", "i", "j").applyInPandas(verify, "text_id long, least long, links long"), "links"
    )
    links = checked.groupBy("text_id").agg(F.sum("links").alias("links"))
    classes = components(checked.where("least <> text_id").select(F.col("text_id").alias("a"), F.col("least").alias("b")))
    named = texts.select("k1", "k2", "text_id", "keeper", "copies").join(links, "text_id", "left") \
        .join(classes, F.col("text_id") == F.col("node"), "left") \
        .withColumn("root", F.coalesce("root", "text_id"))
    named = written(named.drop("node"), "classes")
    least = named.groupBy("root").agg(F.min("keeper").alias("class_id"))
    known = named.join(least, "root").select(
        "k1", "k2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    full = signed.where("n > 0").select("doc_id", "k1", "k2", "n").join(known, ["k1", "k2"]) \
        .select("doc_id", "class_id", "n_links", "k1", "k2", "n")
    none = signed.where("n = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "k1", "k2", "n"
    )
    return full.unionAll(none)
