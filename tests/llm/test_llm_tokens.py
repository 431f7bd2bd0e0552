import random
import zlib

import numpy as np
import pytest
from brute import awkward, documents
from conftest import SMALL
from orrery.llm import encode, packing, tokens
from orrery.llm.wavelet import WaveletMatrix
from orrery.session import fresh_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def direct(name, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encode.tokenizer_path(name))
    return [e.ids + [2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_chunks_encode_as_whole_texts(name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(encode.tokenizer_path(name))
    parts = ["a", "b", "é", "É", "'s", "'", "1", "23", " ", "  ", "\n", "\t", "\xa0", "　", "!", "日本", "ß", "İ", "Σ", "́",
             "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "\r\n", "\x0b", "\x1c", "ﬁ", "🙂", "_", "'re", "x" * 90]
    draw, e = random.Random(3), encode.Encoder(encode.tokenizer_path(name))
    for _ in range(4000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 14)))
        assert e.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert e.encode("x <|endoftext|> y").tolist() == plain.encode("x <|endoftext|> y", add_special_tokens=False).ids


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    for n, bits in ((0, 5), (1, 1), (63, 3), (64, 3), (65, 4), (5000, 16)):
        s = rng.integers(0, 1 << bits, n).astype(np.uint32)
        m = WaveletMatrix.from_bytes(WaveletMatrix.build(s, bits).to_bytes())
        assert (m.symbols() == s).all()
        assert (m.access(np.arange(n)) == s).all()
        for symbol in {*s[:5].tolist(), 0}:
            places = np.flatnonzero(s == symbol)
            assert m.count(symbol) == len(places)
            assert (m.occurrences(symbol) == places).all()
            at = rng.integers(0, n + 1, 20)
            assert (m.rank(np.full(20, symbol), at) == [(s[:i] == symbol).sum() for i in at]).all()


def test_token_files(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    ids = direct(FILES[0], [t for _, t in rows])
    path = fresh_path(spark, "tokens")
    tokens.write_tokens(docs, encode.tokenizer_path(FILES[0]), path, block_tokens=3000)
    found = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in tokens.read_documents(spark, path, with_ids=True).collect())
    start, want = 0, []
    for (d, _), x in zip(rows, ids):
        want.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), x))
        start += len(x)
    assert found == want
    some = [2, ids[0][0], 49_407]
    counted = {r.id: r.n for r in tokens.token_counts(spark, path, some).collect()}
    assert counted == {i: sum(x.count(i) for x in ids) for i in some}
    places = sorted(tuple(r) for r in tokens.occurrences(spark, path, ids[0][0]).collect())
    assert places == sorted((d, p) for (d, _), x in zip(rows, ids) for p, i in enumerate(x) if i == ids[0][0])
    at = {r.place: r.id for r in tokens.token_at(spark, path, rows[3][0], [0, 1, len(ids[3]) - 1, len(ids[3])]).collect()}
    assert at == {p: ids[3][p] for p in {0, 1, len(ids[3]) - 1}}


def test_awkward_rows(spark):
    rows = awkward()
    docs = documents(spark, rows)
    found = tokens.tokenized(docs, encode.tokenizer_path(FILES[0])).orderBy("start").collect()
    assert len(found) == len(rows)
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)
    lengths = sorted(map(len, direct(FILES[0], [r[1] for r in rows])))
    assert sorted(r.n_tokens for r in found) == lengths
    assert tokens.tokenized(docs.limit(0), encode.tokenizer_path(FILES[0])).count() == 0


def test_best_fit():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1024, 3000)
    bins = packing.best_fit(sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(sizes[b].sum() <= 1024 for b in bins)
    assert len(bins) <= 1.02 * sizes.sum() / 1024 + 1


def test_packing(spark):
    from brute import packed

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids = dict(zip([d for d, _ in rows], direct(FILES[1], [t for _, t in rows])))
    path = encode.tokenizer_path(FILES[1])
    least = -(-sum(map(len, ids.values())) // 1024)
    assert packed([tuple(r) for r in packing.pack(docs, path).collect()], ids) <= 1.03 * least + 1
    # Several rounds in small partitions give whole results as well.
    assert packed([tuple(r) for r in packing.pack(docs, path, items=20).collect()], ids) <= 1.1 * least + 1
    kept = packing.pack(docs, path, keep_ids=True).collect()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start:r.start + r.length] for r in kept)


def test_packing_awkward_rows(spark):
    rows = awkward()
    out = packing.pack(documents(spark, rows), encode.tokenizer_path(FILES[1])).collect()
    assert sum(r.length for r in out) == sum(map(len, direct(FILES[1], [r[1] for r in rows])))
    assert sum(r.piece == 0 for r in out) == len(rows)
    assert packing.pack(documents(spark, rows).limit(0), encode.tokenizer_path(FILES[1])).count() == 0
