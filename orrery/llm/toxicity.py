"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel of two words sums over the character subsequences of length two and three that they
share, each weighted by DECAY to the length it spans in both, so that gaps and inserted
characters lower it only a little. It is normalised to 1 for equal words, raised to a power, and
zero for words that lack over a quarter of the landmark's letters, or over half of its neighbouring letter
pairs even with up to two letters in between. A text is the set of its
words (runs of single letters count as one word as well), and its kernel with a landmark is the
largest of its words. Landmarks are words and word beginnings that labelled texts show to mark
toxicity: each toxic training text names the strongest marks it has, so that every text with a mark
is covered, whatever its language's share. A word that begins with a landmark has the kernel 1. Kernels with the landmarks become features by K_mm^-1/2 (Nystroem), and a linear machine
with squared hinge loss and Platt's sigmoid scores them.

Null and empty texts have no word and get the score of the bias. Rows repeat as they come, ties
in the choice of landmarks are settled by text, extra columns stay untouched, and an empty
table gives an empty one. Without labels of both kinds every score is 0; where no word passes as a
mark, as with few labels, every score is the share of toxic labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from orrery.llm.common import flat, per_worker, small_batches, text_of, written

DECAY = 0.5
# The normalised kernel is taken to this power (a kernel again): likeness by chance fades.
# Below the floor it counts as zero.
POWER, FLOOR = 3, 0.3
# Long words are cut into overlapping pieces of this many letters: every part is seen.
PIECE = 24
# Labelled rows a class that the machine is fitted on, besides some toxic texts of each landmark;
# landmarks are chosen from all labelled training rows.
TRAIN_ROWS, TEXTS_A_MARK = 4000, 8
# A mark needs so many toxic texts, to be so many times as frequent there as in clean ones, and counts
# that fewer than one of all candidates would reach by chance: a few texts, whatever the number of
# labels. A text names so many of its marks.
SUPPORT, ODDS, NAMED = 3, 24, 8
# Labels and candidates that are broadcast at once; more take more passes over the texts.
LABELS_A_PASS, CANDIDATES_A_PASS = 1_000_000, 200_000
# Places of letter pairs, words compared with all landmarks at once, and pairs of a word and a landmark whose
# kernels are formed at once.
PLACES, WORDS, PAIRS = 251, 4096, 2048
RIDGE = 2e-4
# Words whose kernels a worker keeps, and the size of their rows, but for a single text with more words.
CACHE, ROW_BYTES = 300_000, 112 << 20
NOT_LETTER = re.compile(r"[\W\d_]+")
SINGLES = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")


def plain(word: str) -> str:
    """A word's letters in lower case; punctuation and digits count as gaps that are left out."""
    word = word.lower()
    return word if word.isalpha() else NOT_LETTER.sub("", word)


def pieces(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[i:i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


def words_of(text: str) -> set[str]:
    found = set(text.split())
    found.update("".join(m.split()) for m in SINGLES.findall(text))
    return found


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters as numbers, each word's length and where it starts."""
    joined = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return joined, sizes, np.cumsum(sizes) - sizes


def _codes(words: list[str], width: int, pad: int, cut: bool = False) -> np.ndarray:
    """Words as rows of character codes, filled up with `pad`; with `cut`, longer words lose their ends."""
    joined, sizes, starts = _letters(words)
    out = np.full((len(words), width), pad, np.int32)
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(joined.size) - starts[row]
    held = place < width if cut else slice(None)
    out[row[held], place[held]] = joined[held]
    return out


def _masks(words: list[str]) -> np.ndarray:
    """The letters of each word as bits of one number; two letters may share a bit."""
    joined, sizes, starts = _letters(words)
    out = np.zeros(len(words), np.uint64)
    some = sizes > 0
    if joined.size:
        out[some] = np.bitwise_or.reduceat(np.uint64(1) << (joined % 64).astype(np.uint64), starts[some])
    return out


def _pair_marks(words: list[str], reach: int) -> np.ndarray:
    """The ordered letter pairs of each word, up to `reach` letters apart, as a row of zeros and ones; two pairs may share a place."""
    joined, sizes, _ = _letters(words)
    out = np.zeros((len(words), PLACES), np.float32)
    row, joined = np.repeat(np.arange(len(words)), sizes), joined.astype(np.int64)
    for d in range(1, reach + 1):
        same = row[d:] == row[:-d]
        out[row[d:][same], ((joined[:-d] * 37 + joined[d:]) % PLACES)[same]] = 1
    return out


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Row-wise kernel of two code matrices (pads of s and t differ): lengths 2 and 3, 3 counted fourfold."""
    rows, width = t.shape
    j = np.arange(width)
    carry = np.where(j[None, :] >= j[:, None], DECAY ** (2.0 + j[None, :] - j[:, None]), 0.0).astype(np.float32)
    one, two = (np.zeros((rows, width), np.float32) for _ in range(2))
    total = np.zeros((rows, width), np.float32)
    for a in range(s.shape[1]):
        hit = (s[:, a:a + 1] == t).astype(np.float32)
        longer, pair = hit.copy(), hit.copy()
        longer[:, 1:] *= two[:, :-1]
        longer[:, 0] = 0
        pair[:, 1:] *= one[:, :-1]
        pair[:, 0] = 0
        total += pair
        total += 4 * longer
        two = DECAY * two + pair @ carry
        one = DECAY * one + hit @ carry
    return DECAY ** 2 * total.sum(1, dtype=np.float64)


@dataclass
class WordKernel:
    """Kernels of words with the landmarks, kept for words seen before."""

    landmarks: list[str]
    seen: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.width = max(map(len, self.landmarks), default=1)
        self.codes = _codes(self.landmarks, self.width, -2)
        self.bits = _masks(self.landmarks)
        self.need = np.ceil(np.bitwise_count(self.bits) * 0.75).astype(np.int64)
        self.pairs = np.ascontiguousarray(_pair_marks(self.landmarks, 1).T)
        self.need_pairs = np.ceil(self.pairs.sum(axis=0) / 2)
        own = _codes(self.landmarks, self.width, -1)
        self.norm = np.sqrt(subsequence_kernel(own, self.codes)) if self.landmarks else np.zeros(0)
        self.exact = {m: i for i, m in enumerate(self.landmarks)}
        self.rows = np.zeros((1024, len(self.landmarks)), np.float32)  # row 0: no landmark is near
        self.used = 1

    def kernels(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        masks = _masks(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        w, mark = [], []
        for at in range(0, len(words), WORDS):
            # One product counts the neighbouring pairs that each word shares with each landmark.
            shared = _pair_marks(words[at:at + WORDS], 3) @ self.pairs
            i, m = np.nonzero(shared >= self.need_pairs)
            i += at
            near = (np.bitwise_count(masks[i] & self.bits[m]) >= self.need[m]) & (sizes[i] > 1)
            w.append(i[near])
            mark.append(m[near])
        w, mark = flat(w, np.int64), flat(mark, np.int64)
        order = np.argsort(sizes[w], kind="stable")
        w, mark = w[order], mark[order]
        # Adjacent letters alone give every word this much of a kernel with itself.
        least = (sizes - 1) * DECAY ** 4 + 4 * np.maximum(sizes - 2, 0) * DECAY ** 6
        codes = _codes(words, int(sizes[w].max(initial=1)), -1, cut=True)
        good_i, good_m, good_k = [], [], []
        for at in range(0, len(w), PAIRS):
            i, m = w[at:at + PAIRS], mark[at:at + PAIRS]
            k = subsequence_kernel(codes[i, :sizes[i[-1]]], self.codes[m]) / self.norm[m]
            good = k >= FLOOR * np.sqrt(least[i])
            good_i.append(i[good])
            good_m.append(m[good])
            good_k.append(k[good])
        i, m, k = flat(good_i, np.int64), flat(good_m, np.int64), flat(good_k, float)
        distinct = np.unique(i)
        distinct = distinct[np.argsort(sizes[distinct], kind="stable")]
        own = np.ones(len(words))
        for at in range(0, len(distinct), PAIRS):
            part = distinct[at:at + PAIRS]
            mine = codes[part, :sizes[part[-1]]]
            own[part] = subsequence_kernel(mine, np.where(mine < 0, -2, mine))
        k = k / np.sqrt(own[i])
        out[i, m] = np.where(k >= FLOOR, k ** POWER, 0)
        for i, word in enumerate(words):
            for n in range(2, min(len(word), self.width) + 1):
                m = self.exact.get(word[:n])
                if m is not None and (n > 3 or n == len(word)):
                    out[i, m] = 1
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.seen]
        most = ROW_BYTES // max(1, 4 * len(self.landmarks))
        if new and (len(self.seen) + len(new) > CACHE or self.used + len(new) > most):
            self.seen.clear()
            self.used = 1
            self.rows = self.rows[:1024].copy()
            new = list(words)
        for at in range(0, len(new), WORDS):
            self._add(new[at:at + WORDS])

    def _add(self, new: list[str]) -> None:
        parts = [pieces(plain(w)) for w in new]
        kernels = self.kernels([p for ps in parts for p in ps])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(sizes) - sizes
        best, long = kernels[starts], np.flatnonzero(sizes > 1)
        for i in long:
            best[i] = kernels[starts[i]:starts[i] + sizes[i]].max(axis=0)
        near = best.any(1)
        count = int(near.sum())
        if self.used + count > len(self.rows):
            most = ROW_BYTES // (4 * self.rows.shape[1])
            wider = np.zeros((max(self.used + count, min(2 * len(self.rows), most)), self.rows.shape[1]), np.float32)
            wider[:self.used] = self.rows[:self.used]
            self.rows = wider
        index = np.where(near, self.used + np.cumsum(near) - 1, 0)
        self.rows[self.used:self.used + count] = best[near]
        self.used += count
        self.seen.update(zip(new, index.tolist(), strict=True))

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.landmarks)), np.float32)
        if not self.landmarks:
            return out
        sets = [words_of(x) for x in texts]
        at = 0
        while at < len(sets):  # as many texts at once as the cache can hold
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= 4 * WORDS):
                size += len(sets[end])
                end += 1
            self.learn(set().union(*sets[at:end]))
            for i in range(at, end):
                rows = {self.seen[w] for w in sets[i]}
                rows.discard(0)
                if rows:
                    out[i] = self.rows[list(rows)].max(0)
            at = end
        return out


@dataclass
class Machine:
    """Landmarks, the Nystroem map with the machine's weights folded in, and Platt's sigmoid."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = self.slope * (features @ self.weights + self.bias) + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, share): the labelled training rows, with a hash of the id as a share of one."""
    return (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30))
    )


def labelled_texts(docs: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """text, toxic, share of `docs` with a label: texts are not shuffled, labels are broadcast part by part."""
    parts = max(1, -(-count // LABELS_A_PASS))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts))
    found = None
    for i in range(parts):
        joined = docs.select("doc_id", "text").join(F.broadcast(known.where(part == i)), "doc_id").select("text", "toxic", "share")
        found = joined if found is None else found.unionAll(joined)
    return found


def candidates(text: str) -> set[str]:
    """A text's words, and their beginnings of four to twelve letters."""
    found = set()
    for w in {q for w in words_of(text) for q in pieces(plain(w))}:
        if len(w) > 3:
            found.update(w[:n] for n in range(4, min(len(w), 12) + 1))
        elif len(w) > 1:
            found.add(w)
    return found


def candidate_counts(texts: DataFrame, among: set[str] | None = None) -> DataFrame:
    """mark, n: how many texts have each candidate."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Counter()
        for b in batches:
            for text in b["text"]:
                found = candidates(text_of(text))
                tally.update(found if among is None else found & among)
        keys = list(tally)
        for at in range(0, len(keys), 50_000):
            part = keys[at:at + 50_000]
            yield pd.DataFrame({"mark": part, "n": [tally[k] for k in part]})

    return texts.select("text").mapInPandas(count, "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))


def marking(texts: DataFrame, bad_texts: int, good_texts: int) -> dict[str, float]:
    """Candidates with the support and the odds, over all labelled training texts, and their gain."""
    bad = written(candidate_counts(texts.where("toxic = 1")).where(F.col("n") >= SUPPORT), "toxicity-candidates")
    tried, found = bad.count(), {}
    share = bad_texts / (bad_texts + good_texts)
    # With fewer texts than this a candidate fails the chance rule even if no clean text has it.
    bad = bad.where(F.col("n") * -float(np.log(share)) >= float(np.log(max(1, tried))))
    parts = max(1, -(-bad.count() // CANDIDATES_A_PASS))
    for i in range(parts):
        counts = bad.where(F.pmod(F.xxhash64("mark"), F.lit(parts)) == i).toPandas()
        toxic = dict(zip(counts["mark"], counts["n"].tolist(), strict=True))
        good = candidate_counts(texts.where("toxic = 0"), set(toxic)).toPandas()
        clean = dict(zip(good["mark"], good["n"].tolist(), strict=True))
        for mark, n in toxic.items():
            m = clean.get(mark, 0)
            # Logarithm of the chance (by Chernoff's bound) that so many of a word's texts are toxic.
            chance = n * np.log(share * (n + m) / n) + (m * np.log((1 - share) * (n + m) / m) if m else 0.0)
            if n * good_texts >= ODDS * m * bad_texts and np.log(tried) + chance <= 0:
                found[mark] = n * float(np.log((n + 0.5) / (bad_texts + 1) / ((m + 0.5) / (good_texts + 1))))
    return found


def strongest(marks: set[str], gain: dict[str, float]) -> list[str]:
    """The marks with most gain, ties by length and letters, none of them a beginning of another."""
    found: list[str] = []
    for m in sorted(marks, key=lambda m: (-gain[m], -len(m), m)):
        if not any(m.startswith(x) or x.startswith(m) for x in found):
            found.append(m)
            if len(found) == NAMED:
                break
    return found


def named_marks(texts: DataFrame, gain: dict[str, float]) -> DataFrame:
    """text, share, marks: the strongest marks of each text."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            marks = [strongest(candidates(text_of(x)) & gain.keys(), gain) for x in b["text"]]
            yield pd.DataFrame({"text": b["text"], "share": b["share"], "marks": marks})

    return texts.select("text", "share").mapInPandas(name, "text string, share double, marks array<string>")


def choose_landmarks(votes: dict[str, int]) -> list[str]:
    """All marks that toxic texts name but those that begin with another one: their texts have that one too."""
    return sorted(m for m in votes if not any(m[:n] in votes for n in range(4, len(m))))


def fit_machine(features: np.ndarray, toxic: np.ndarray, landmarks: list[str]) -> Machine:
    """Squared hinge loss with balanced classes on Nystroem features by gradient steps; then Platt."""
    y = np.where(toxic == 1, 1.0, -1.0)
    kernel = WordKernel(landmarks).kernels(landmarks).astype(float)
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    x = np.hstack([features @ root, np.ones((len(y), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps over the rows inside the margin
        slack = 1 - y * (x @ w)
        inside = slack > 0
        xi, wi = x[inside], weight[inside]
        gradient = ridge * w - (wi * y[inside] * slack[inside]) @ xi
        step = np.linalg.solve((xi * wi[:, None]).T @ xi + np.diag(ridge), gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    z = x @ w
    slope, shift, target = 2.0, 0.0, np.where(y > 0, 0.98, 0.02)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        g = np.array([((p - target) * z).mean(), (p - target).mean()])
        v = p * (1 - p)
        h = np.array([[(v * z * z).mean(), (v * z).mean()], [(v * z).mean(), v.mean()]]) + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, g)
        slope, shift = slope - d[0], shift - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return Machine(landmarks, root @ w[:-1], float(w[-1]), float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine | None:
    """The machine for `score`; only candidates, landmarks, counts and one short feature row a text reach the driver."""
    small_batches(docs.sparkSession)
    known = known_labels(labels)
    texts = labelled_texts(docs, known, known.count())
    totals = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    gain = marking(texts, totals[1], totals[0])
    named = written(named_marks(texts.where("toxic = 1"), gain), "toxicity-named")
    votes = {r["mark"]: r["count"] for r in named.select(F.explode("marks").alias("mark")).groupBy("mark").count().collect()}
    landmarks = choose_landmarks(votes)
    if not landmarks:
        return Machine([], np.zeros(0), float(np.log(totals[1] / totals[0])))
    usual = rows / totals[1]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = WordKernel(landmarks)
        for b in batches:
            # Of rarely named marks all texts are kept, of the others some at least.
            keep = [s < max([usual, *(TEXTS_A_MARK / votes[m] for m in ms)]) for s, ms in zip(b["share"], b["marks"], strict=True)] \
                if "marks" in b else [True] * len(b)
            yield pd.DataFrame({"f": list(kernel.features([text_of(x) for x, k in zip(b["text"], keep, strict=True) if k]))})

    clean = texts.where((F.col("toxic") == 0) & (F.col("share") < rows / totals[0])).select("text")
    bad, good = (
        np.array([r for r in x.mapInPandas(features, "f array<float>").toPandas()["f"]], float).reshape(-1, len(landmarks)) for x in (named, clean)
    )
    return fit_machine(np.vstack([bad, good]), np.repeat([1, 0], [len(bad), len(good)]), landmarks)


def score(text: Column, machine: Machine | None) -> Column:
    """The score of a text column, 0 to 1."""
    if machine is None:
        return F.lit(0.0)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kernel = per_worker("word kernel", tuple(machine.landmarks), lambda: WordKernel(machine.landmarks))
        for b in batches:
            yield pd.Series(machine.scores(kernel.features([text_of(x) for x in b]).astype(float)))

    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    machine = train(docs, labels, rows)
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), machine).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
