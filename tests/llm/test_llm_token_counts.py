import pytest
from brute import awkward, documents
from conftest import SMALL
from orrery.llm import token_counts
from orrery.llm.encode import tokenizer_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


def direct(name, text):
    if name.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name)).encode(text or ""))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids)


def plain(name, rows, limit):
    counts = [(r[0], len((r[1] or "").encode()), direct(name, r[1])) for r in rows]
    return sorted(((d, b, n, n > limit) for d, b, n in counts), key=str)


@pytest.mark.parametrize("name", FILES)
def test_counts_against_the_library(spark, name):
    special = [(20, "x <|endoftext|> y"), (21, "<|startoftext|>" * 3), (22, "<|ENDOFTEXT|> It's 1234 İstanbul\x1c ok")]
    rows = awkward(special)
    # A table of three entries sends nearly all pre-tokens to the caches; it changes no count.
    for entries in (3, token_counts.ENTRIES):
        found = token_counts.counted(documents(spark, rows).repartition(5), tokenizer_path(name), limit=100, entries=entries)
        assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((tuple(r) for r in found.collect()), key=str) == plain(name, rows, 100)
    assert token_counts.counted(documents(spark, []), tokenizer_path(name)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = token_counts.counted(docs, tokenizer_path(FILES[0]))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(FILES[0], rows, token_counts.LIMIT)


def test_summaries_keep_what_is_frequent(spark):
    rare = lambda i: chr(97 + i % 25) + chr(97 + i // 25)
    rows = [(i, "the cat " * 20 + " ".join("z" + rare(i) + rare(j) for j in range(60)), None, "s", 1, 1, 1, "", "", 0.0) for i in range(200)]
    table = token_counts.frequent(documents(spark, rows).repartition(70), tokenizer_path(FILES[0]), entries=8)
    assert {"the", "cat"} <= {s for _, s, _ in table} and len(table) <= 8
    assert all(n == direct(FILES[0], s) for _, s, n in table)
