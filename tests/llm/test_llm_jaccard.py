import numpy as np
from brute import awkward, by_text, documents, near
from conftest import SMALL
from orrery.llm import graph, jaccard


def got(df):
    return by_text(tuple(r) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got(jaccard.near_copies(docs)) == by_text(near([(r.doc_id, r.text) for r in docs.collect()]))


def family(start, count, base, edits, seed):
    """Near copies of one text, each with a few words of its own."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(count):
        w = [f"{base}{i}" for i in range(100)]
        for p in rng.choice(100, edits, replace=False):
            w[p] = f"own{k}x{p}"
        out.append((start + k, " ".join(w)))
    return out


def test_awkward_rows_and_families(spark):
    rows = awkward(family(1000, 60, "f", 1, 1) + family(2000, 30, "g", 3, 2) + family(3000, 20, "h", 12, 3))
    assert got(jaccard.near_copies(documents(spark, rows))) == by_text(near([(r[0], r[1]) for r in rows]))


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2000)
    rows = family(0, 60, "f", 1, 4) + family(100, 15, "g", 2, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.near_copies(docs)) == by_text(near(rows))


def test_one_of_each_class_stays(spark):
    rows = awkward(family(1000, 10, "f", 1, 6))
    docs = documents(spark, rows)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    classes = {(d, c) for d, c, _ in near([(r[0], r[1]) for r in rows])}
    assert ids == sorted({d for d, c in classes if d == c and d is not None})
    assert kept.where("doc_id IS NULL").count() == 1  # of the null ids, the text without words
    assert jaccard.keep_first(docs.limit(0)).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 60 if k % 2 else 4000, rng.integers(1, 90)).astype(np.uint64)) for k in range(90)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    same = jaccard.shared_counts(sets, 90, True)
    np.fill_diagonal(same, np.diag(want))  # a set is not compared with itself
    assert (same == want).all()
    assert (jaccard.shared_counts(sets, 40, False) == want[:40, 40:]).all()


def test_depth_keeps_recall():
    d = jaccard.depth(0.8)
    assert 1 - (1 - 0.8 ** d) ** jaccard.TREES >= jaccard.RECALL
    assert jaccard.depth(0.5) < d


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)] + [(500, 500 + k) for k in range(1, 30)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {500 + k: 500 for k in range(30)}
