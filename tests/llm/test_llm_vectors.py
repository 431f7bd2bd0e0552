import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL
from orrery.llm import vector_codes, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x long, code string, component int, n long, part int"


def awkward(width=8, count=40, seed=1):
    """Vectors with nulls everywhere, ties, repeats, a hot vector, and clashing columns."""
    rng = np.random.default_rng(seed)
    of = lambda i, v, label=1: (i, v, label, 1, "c", 2, 3, None)
    some = [of(i, [float(x) for x in rng.integers(-3, 4, width) / 2], int(rng.integers(0, 3))) for i in range(count)]
    hot = [of(100 + i, [0.25] * width, 7) for i in range(count)]
    bad = [of(200, None), of(201, [None] + [0.0] * (width - 1)), of(202, [math.nan] * width), of(203, [math.inf] * width), of(204, [])]
    return some + hot + bad + [some[0], of(None, [1.0] * width, None), of(None, None, None), of(5, [-1.5] * width, None)]


def kept(rows):
    return [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]


def lloyd(rows, parts=4, entries=256, rounds=4):
    """Plain version of the codes in Python integers."""
    rows = [(r[0], r[2], [math.floor(1024 * x) for x in r[1]]) for r in kept(rows)]
    width = len(rows[0][2]) // parts
    cut = lambda x: [x[p * width:(p + 1) * width] for p in range(parts)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0], r[2]) if r[0] is not None else (True, 0, r[2]))[:entries]
    books = [[cut(x)[p] for _, _, x in first] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, _, x in rows:
                held[near(cut(x)[p], books[p])[1]].append(cut(x)[p])
            for e, vs in held.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for i, label, x in rows:
        found = [near(v, b) for v, b in zip(cut(x), books)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        total[label] += out[-1][3]
    return sorted(((i, c, e, total[label], digest) for i, label, c, e in out), key=str)


def test_walk_finds_the_nearest():
    rng = np.random.default_rng(2)
    for n, m, width, span in ((1, 1, 1, 3), (5, 2, 2, 2), (700, 256, 3, 4), (900, 40, 16, 900), (600, 256, 1, 2), (3000, 256, 2, 90_000)):
        points, entries = rng.integers(-span, span + 1, (n, width)), rng.integers(-span, span + 1, (m, width))
        points[: n // 3] = points[0]
        tree, found = vector_codes.grown(points, vector_codes.LEAF), np.full(n, -1)
        for start, end, entry, whole in vector_codes.assign(tree, vector_codes.Book(entries)):
            found[tree.places[start:end]] = entry
            assert whole is None or (whole == tree.points[start:end].sum(axis=0)).all()
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (found == d.argmin(axis=1)).all()


def test_clustered_nodes_are_assigned_whole():
    rng = np.random.default_rng(3)
    centres = rng.integers(-100_000, 100_000, (8, 4))
    points = np.repeat(centres, 1000, axis=0) + rng.integers(-5, 6, (8000, 4))
    book = vector_codes.Book(centres)
    pieces = list(vector_codes.assign(vector_codes.grown(points, vector_codes.LEAF), book))
    whole = sum(end - start for start, end, _, s in pieces if s is not None)
    assert whole > 7000 and len(pieces) < 100


@pytest.mark.parametrize("entries", [3, 256])
def test_codes_against_plain_lloyd(spark, entries):
    rows = awkward()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = vector_codes.vector_codes(df, entries=entries, block=16)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == lloyd(rows, entries=entries)


def test_codes_of_odd_lengths_and_bounds(spark):
    rows = [(i, [float(i), 1.0, 2.0], 1) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert [(r.code[:6], r.error) for r in vector_codes.vector_codes(df).orderBy("vec_id").collect()] == [(f"{i:02x}0000", 0) for i in range(5)]
    assert vector_codes.vector_codes(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="lengths"):
        vector_codes.vector_codes(df.union(df.selectExpr("vec_id", "slice(embedding, 1, 2)", "label")))
    with pytest.raises(Exception, match="component"):
        vector_codes.vector_codes(df.selectExpr("vec_id", "transform(embedding, x -> cast(x * 1e9 AS float)) AS embedding", "label"))


def whitened(rows, components=16):
    """Plain version in numpy: (vec_id, component) to deviation, |whitened|, explained."""
    rows = kept(rows)
    x = np.array([[math.floor(64 * v) + 1_000_000 for v in r[1]] for r in rows])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = n * fit - total
    values, vectors = np.linalg.eigh((centred.T @ centred).astype(float) / n ** 3)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, x.shape[1])
    w = ((n * x - total) / n) @ vectors[:, :k] / np.sqrt(values[:k])
    dev = ((n * x - total) ** 2).sum(axis=1)
    return n, [(r[0], c + 1, int(dev[i]), abs(w[i, c]), values[c] / values.sum()) for i, r in enumerate(rows) for c in range(k)]


def check_whitening(found, rows):
    n, want = whitened(rows)
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6))
    got = sorted(((r.vec_id, r.component, r.deviation, abs(r.whitened), r.explained) for r in found), key=key)
    want = sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-6, atol=1e-7)
    assert {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1
    assert max(r.identity_error for r in found) <= 1e-6
    assert all(int(r.deviation_exact) == r.deviation for r in found)


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check_whitening(whitening.whiten(df).collect(), rows)


def test_whitening_of_awkward_rows(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, VECTORS)
    found = whitening.whiten(df)
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(found.collect(), rows)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("label = 7")).count() == 0  # one vector has no variance
    # A constant dimension has no component of its own.
    flat = df.where("vec_id < 40 AND size(embedding) > 0").selectExpr("vec_id", "concat(embedding, array(cast(2 AS float))) AS embedding")
    assert {r.component for r in whitening.whiten(flat).collect()} == set(range(1, 9))


def test_squares_and_centres_of_any_size():
    rng = np.random.default_rng(5)
    for span in (10, 1 << 30, 1 << 46):
        x = rng.integers(-span, span, (300, 4))
        n, sums = 300, [int(v) for v in x.astype(object).sum(axis=0)]
        z = whitening.centred(x, n, sums)
        exact = n * x.astype(object) - np.array(sums, dtype=object)
        assert (z == exact).all()
        assert list(whitening.squares(z)) == list((exact * exact).sum(axis=0))
