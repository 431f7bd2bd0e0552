"""Vector codes by dual-tree Lloyd rounds.

Vectors become integers, floor(SCALE * x), and are cut into equal consecutive parts; each part position has
a codebook. `grow` writes blocks of vectors to the shared folder, each with one tree a part position: points
in tree order, and for every node its box and its cached sum. A round walks a block's tree and the codebook's
tree together. Distance bounds between the boxes of two nodes rule combinations out; a node that is left with
one entry is assigned whole, by its cached sum; only leaves that stay uncertain compare integers point by
point. Blocks give at most one sum an entry and position, which Spark adds up, so that a round shuffles and
returns codebooks, however many vectors there are.

Dropped are rows whose vector is null, is empty, or holds a null or non-finite component. Vectors of different
lengths raise an error, as does a component of BOUND / SCALE or more, beyond which errors would leave a long.
Where the length is no multiple of the number of parts, the first parts have one component more; no part is
empty, so that short vectors have fewer parts. The first codebook takes the smallest vec_ids, null ids last, equal ids by their vectors; fewer vectors give fewer entries. Ties of
distance go to the lower entry. Equal vectors, even a third of all, fill nodes without extent, which are
assigned whole. Repeated rows keep a row each. An empty table gives no rows. Null labels are one label.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Vectors of a block, points of a leaf of its trees, entries of a leaf of the codebooks' trees.
BLOCK, LEAF, ENTRY_LEAF = 1 << 14, 128, 4
BOUND = 1 << 27
# Labels with a thousandth of the rows or more: at most a thousand, sent to every task.
HOT_SHARE = 1000
TREE = "struct<points: binary, places: binary, low: binary, high: binary, sums: binary>"
BLOCKS = f"vec_ids array<long>, labels array<long>, n int, trees array<{TREE}>"


class Tree(NamedTuple):
    """Points in tree order and their places before. Node k of a level covers points k*n >> level to (k+1)*n >> level;
    nodes are kept level by level, from the root."""

    points: np.ndarray
    places: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def depth(n: int, leaf: int) -> int:
    """Levels below the root until a node holds `leaf` points at most. No node is empty, as leaf is 1 or more."""
    d = 0
    while n > leaf << d:
        d += 1
    return d


def edges(n: int, level: int) -> np.ndarray:
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def grown(points: np.ndarray, leaf: int) -> Tree:
    """A balanced tree: each node's points are cut at the middle of its widest dimension."""
    n, levels = len(points), depth(len(points), leaf)
    places = np.arange(n)
    low, high, sums = [], [], []
    for level in range(levels + 1):
        cuts = edges(n, level)
        low.append(np.minimum.reduceat(points, cuts[:-1]))
        high.append(np.maximum.reduceat(points, cuts[:-1]))
        sums.append(np.add.reduceat(points, cuts[:-1]))
        if level < levels:
            node = np.repeat(np.arange(1 << level), np.diff(cuts))
            widest = (high[-1] - low[-1]).argmax(axis=1)
            order = np.lexsort((points[np.arange(n), widest[node]], node))
            points, places = points[order], places[order]
    return Tree(points, places, np.concatenate(low), np.concatenate(high), np.concatenate(sums))


class Book:
    """A codebook with what every node asks of it: its tree, squares, and differences between entries."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.tree = entries, grown(entries, ENTRY_LEAF)
        self.levels = depth(len(entries), ENTRY_LEAF)
        # In the tree's order, so that the entries of a tree leaf lie side by side.
        self.owner = np.repeat(np.arange(1 << self.levels), np.diff(edges(len(entries), self.levels)))
        self.squares = (self.tree.points ** 2).sum(axis=1)
        self.steps = self.tree.points[None] - self.tree.points[:, None]

    def kept(self, low: np.ndarray, high: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Which of the combinations (node, entry in tree order) in `near` remain when each node's entry that is
        nearest to the middle of its box has ruled out those that are farther in the whole box.

        Half the difference of two squared distances is linear, so that its extreme lies at a corner of the
        box. An entry just as far there stays if its number is lower.
        """
        middle, span = low + high, high - low
        at = self.squares - middle @ self.tree.points.T
        best = np.where(near, at, np.iinfo(np.int64).max).argmin(axis=1)
        rows = np.arange(len(best))
        steps = self.steps[best]
        gain = at[rows, best][:, None] - at + np.einsum("nd,ned->ne", span, np.abs(steps))
        lower = self.tree.places[None] <= self.tree.places[best][:, None]
        return near & ((gain > 0) | ((gain == 0) & lower))


class Exact:
    """Distances between points and entries in integers."""

    def __init__(self, points: np.ndarray, book: Book):
        self.points, self.entries = points, book.tree.points
        self.places = book.tree.places
        # Below 2**53 in every partial sum, floats hold integers exactly and have the faster product.
        peak = max(np.abs(points).max(initial=0), np.abs(self.entries).max(initial=0))
        self.type = np.float64 if int(peak) ** 2 * points.shape[1] * 4 < 1 << 53 else np.int64
        self.p, self.b, self.squares = points.astype(self.type), -2 * self.entries.astype(self.type), book.squares.astype(self.type)

    def nearest(self, start: int, end: int, left: np.ndarray) -> np.ndarray:
        """The nearest of the entries `left` (places in the book's tree, by ascending number) for the points of a leaf."""
        d = self.p[start:end] @ self.b[left].T
        d += self.squares[left]
        return self.places[left[d.argmin(axis=1)]]


def assign(tree: Tree, book: Book) -> Iterator[tuple[int, int, np.ndarray | int, np.ndarray | None]]:
    """The points in tree order in pieces: (start, end, entry, sum) of a node that is assigned whole, with its
    cached sum, or (start, end, entries of its points, None) of an uncertain leaf.

    Both trees are walked level by level; `near[node, entry node]` holds the combinations still possible.
    """
    n, exact = len(tree.points), Exact(tree.points, book)
    levels = depth(n, LEAF)
    nodes, near = np.zeros(1, np.int64), np.ones((1, 1), bool)
    for level in range(max(levels, book.levels) + 1):
        at, entry_at = min(level, levels), min(level, book.levels)
        if level and at == level:
            nodes = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
            near = np.repeat(near, 2, axis=0)
        if level and entry_at == level:
            near = np.repeat(near, 2, axis=1)
        first, entry_first = (1 << at) - 1, (1 << entry_at) - 1
        low, high = tree.low[first + nodes], tree.high[first + nodes]
        entry_low, entry_high = (x[entry_first:entry_first + (1 << entry_at)] for x in (book.tree.low, book.tree.high))
        a, e = np.nonzero(near)
        gap = np.maximum(0, np.maximum(low[a] - entry_high[e], entry_low[e] - high[a]))
        reach = np.maximum(high[a] - entry_low[e], entry_high[e] - low[a])
        most = np.full(near.shape, np.iinfo(np.int64).max)
        most[a, e] = np.einsum("ij,ij->i", reach, reach)
        near[a, e] = np.einsum("ij,ij->i", gap, gap) <= most.min(axis=1)[a]
        if entry_at < book.levels:
            continue
        # The entries' leaves are reached: nodes with one entry left are assigned whole, others go down.
        left = book.kept(low, high, near[:, book.owner])
        alone = left.sum(axis=1) == 1
        if at < levels and not alone.any():
            near = np.logical_or.reduceat(left, edges(len(book.entries), book.levels)[:-1], axis=1)
            continue
        starts = edges(n, at)
        for k in np.flatnonzero(alone | (at == levels)):
            start, end = int(starts[nodes[k]]), int(starts[nodes[k] + 1])
            if alone[k]:
                yield start, end, int(book.tree.places[left[k].argmax()]), tree.sums[first + nodes[k]]
            else:
                found = np.flatnonzero(left[k])
                yield start, end, exact.nearest(start, end, found[book.tree.places[found].argsort()]), None
        nodes = nodes[~alone]
        near = np.logical_or.reduceat(left[~alone], edges(len(book.entries), book.levels)[:-1], axis=1)
        if not len(nodes):
            return


def packed(tree: Tree) -> dict[str, bytes]:
    return {k: np.ascontiguousarray(v, "<i4" if k in ("points", "places", "low", "high") else "<i8").tobytes()
            for k, v in tree._asdict().items()}


def unpacked(row, n: int) -> Tree:
    width = len(row["points"]) // 4 // n
    get = lambda k, t: np.frombuffer(row[k], t).astype(np.int64)
    return Tree(get("points", "<i4").reshape(n, width), get("places", "<i4"), get("low", "<i4").reshape(-1, width),
                get("high", "<i4").reshape(-1, width), get("sums", "<i8").reshape(-1, width))


def widths(dims: int, parts: int) -> list[int]:
    parts = min(parts, dims)
    return [dims // parts + (i < dims % parts) for i in range(parts)]


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the integers `x` of the rows with a whole vector."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"),
    )


def grow(vectors: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """The blocks of `vectors` (vec_id, label, x), written."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def row() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True)
            x = np.stack(rows["x"].to_numpy()).astype(np.int64)
            if np.abs(x).max() >= BOUND:
                raise ValueError(f"a component of {BOUND // SCALE} or more")
            cuts = np.cumsum([0, *widths(x.shape[1], parts)])
            trees = [packed(grown(x[:, a:b], LEAF)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            whole = lambda c: [None if v is pd.NA else int(v) for v in rows[c].astype("Int64")]
            return pd.DataFrame({"vec_ids": [whole("vec_id")], "labels": [whole("label")], "n": [len(rows)], "trees": [trees]})

        for b in batches:
            for at in range(0, len(b), block):
                held.append(b.iloc[at:at + block])
                if sum(map(len, held)) >= block:
                    yield row()
                    held.clear()
        if held:
            yield row()

    return written(vectors.mapInPandas(blocks, BLOCKS), "vector-blocks")


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Every position's part of the vectors with the smallest vec_ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    x = np.array([r.x for r in rows], np.int64)
    cuts = np.cumsum([0, *widths(x.shape[1], parts)])
    return [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def lloyd_round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: floor(sum / count) of the parts at each entry, unused entries unchanged."""
    spark = blocks.sparkSession
    now = spark.sparkContext.broadcast(books)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = [Book(b) for b in now.value]
        total = [np.zeros(b.shape, np.int64) for b in now.value]
        count = [np.zeros(len(b), np.int64) for b in now.value]
        for batch in batches:
            for r in batch.itertuples(index=False):
                for part, row in enumerate(r.trees):
                    tree = unpacked(row, r.n)
                    for start, end, entry, whole in assign(tree, asked[part]):
                        if whole is not None:
                            total[part][entry] += whole
                            count[part][entry] += end - start
                        else:
                            np.add.at(total[part], entry, tree.points[start:end])
                            np.add.at(count[part], entry, 1)
        for part, (t, c) in enumerate(zip(total, count, strict=True)):
            used = np.flatnonzero(c)
            if len(used):
                yield pd.DataFrame({"part": part, "entry": used, "n": c[used], "total": list(t[used])})

    found = blocks.select("n", "trees").mapInPandas(sums, "part int, entry int, n long, total array<long>")
    # One sum a place of the array: at most parts x entries rows come back, at any number of vectors.
    place = found.select("part", "entry", "n", F.posexplode("total").alias("at", "v"))
    rows = place.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    after = [b.copy() for b in books]
    for r in rows:
        after[r.part][r.entry, r["at"]] = r.v // r.n
    now.unpersist()
    return after


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    now = blocks.sparkSession.sparkContext.broadcast(books)

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = [Book(b) for b in now.value]
        for batch in batches:
            for r in batch.itertuples(index=False):
                found, error = np.zeros((r.n, len(r.trees)), np.int64), np.zeros(r.n, np.int64)
                for part, row in enumerate(r.trees):
                    tree, book = unpacked(row, r.n), asked[part]
                    entry = np.zeros(r.n, np.int64)
                    for start, end, e, _ in assign(tree, book):
                        entry[start:end] = e
                    found[tree.places, part] = entry
                    error[tree.places] += ((tree.points - book.entries[entry]) ** 2).sum(axis=1)
                hexes = found.astype(np.uint8).tobytes().hex()
                width = 2 * found.shape[1]
                yield pd.DataFrame({
                    "vec_id": pd.array(list(r.vec_ids), "Int64"), "label": pd.array(list(r.labels), "Int64"),
                    "code": [hexes[i:i + width] for i in range(0, len(hexes), width)], "error": error,
                })

    return blocks.mapInPandas(codes, "vec_id long, label long, code string, error long")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """`rows` with the error summed over equal labels. Sums are grouped before they are shuffled; labels that hold
    a thousandth of all rows (so a thousand of them at most) are sent to every task, only the others are joined by key."""
    totals = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    n = totals.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE >= n
    named = lambda df: df.select(F.col("label").alias("of"), "label_error")
    hot, cold = named(totals.where(is_hot)), named(totals.where(~is_hot))
    met = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    rest = met.where("label_error IS NULL").drop("label_error").join(cold, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return met.where("label_error IS NOT NULL").unionByName(rest)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of `vectors` (vec_id, embedding, label)."""
    if entries > 256:
        raise ValueError("a code has two hex digits an entry: 256 entries at most")
    kept = finite(vectors)
    sizes = [r[0] for r in kept.select(F.size("x").alias("d")).distinct().orderBy("d").limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes}")
    if not sizes:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    blocks, books = grow(kept, parts, block), first_books(kept, parts, entries)
    for _ in range(rounds):
        books = lloyd_round(blocks, books)
    rows = written(coded(blocks, books), "vector-codes")
    return with_label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
