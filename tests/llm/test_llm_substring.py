import numpy as np
from brute import awkward, by_text, dedup, documents
from conftest import SMALL
from orrery.llm import substring


def got(df):
    return by_text(tuple(r)[:4] for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = by_text(dedup([(r.doc_id, r.text) for r in docs.collect()]))
    assert got(substring.dedup(docs)) == want


def test_awkward_rows_and_blocks(spark):
    shared = " ".join(f"s{i}" for i in range(120))
    # Many contexts around one passage, pairs that share part of them, and a passage inside one text twice.
    extra = [(100 + i, f"{' '.join(f'c{i // 2}k{j}' for j in range(40))} {shared} {' '.join(f't{i % 3}k{j}' for j in range(30))}") for i in range(40)]
    extra += [(200, shared + " mid " + shared), (201, " ".join(["again"] * 200)), (202, " ".join(["again"] * 90))]
    rows = awkward(extra)
    want = by_text(dedup([(r[0], r[1]) for r in rows]))
    docs = documents(spark, rows)
    assert got(substring.dedup(docs)) == want
    assert got(substring.dedup(docs, shard_words=300)) == want


def test_kept_text_and_empty_table(spark):
    docs = documents(spark, awkward())
    row = substring.dedup(docs, with_text=True).where("doc_id = 2").first()
    assert row.kept == "before after" and row.n_removed == 70
    assert substring.dedup(docs.limit(0)).count() == 0


def test_matching_statistics():
    """Against all substrings of all texts."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 4, rng.integers(3, 30)).astype(np.uint64) for _ in range(40)]
    docs = rng.integers(0, 12, len(texts)).astype(np.int32)
    found = substring.FMIndex(texts, docs).matches(texts, docs)
    for k, t in enumerate(texts):
        below = {tuple(x[i:j]) for x, d in zip(texts, docs) if d < docs[k] for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        for i in range(len(t)):
            longest = max((n for n in range(len(t) - i + 1) if n == 0 or tuple(t[i:i + n]) in below), default=0)
            assert found[k][i] == longest


def test_equal_windows_get_equal_anchors():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 1 << 62, 80).astype(np.uint64)
    seen = []
    for n in (0, 7, 33):
        text = np.concatenate([rng.integers(0, 1 << 62, n).astype(np.uint64), passage])
        start, windows, anchor, *_ = substring.segments(text)
        by_window = np.repeat(anchor, windows)
        assert len(by_window) == len(text) - 49
        seen.append(by_window[n:].tolist())
    assert seen[0] == seen[1] == seen[2]
