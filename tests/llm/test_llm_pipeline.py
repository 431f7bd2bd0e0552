"""Each stage against its plain version, on its own input."""

import sys

sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))

import corpus_pipeline
import __spark_entry__ as entry_points
from brute import awkward, bench_words, contaminated, documents, near, base_spans, packed
from conftest import SMALL
from orrery.llm import encode, secret_scan, toxicity
from pyspark.sql import functions as F


def texts(df):
    return {(r.doc_id, r.text) for r in df.collect()}


def test_stages_in_order(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    assert entry_points.queries()["pipeline"] is corpus_pipeline.run


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    after = stage["toxicity"](spark, docs, SMALL)
    assert after.columns == columns
    machine = toxicity.train(docs, labels)
    toxic = {r.doc_id for r in docs.withColumn("s", toxicity.score(docs["text"], machine)).where("s >= 0.5").collect()}
    assert {d for d, _ in texts(docs)} - {d for d, _ in texts(after)} == toxic and toxic

    rows = sorted(texts(after))
    kept = stage["n-gram Jaccard join"](spark, after, SMALL)
    assert kept.columns == columns
    assert texts(kept) == {r for r, (d, c, _) in zip(rows, near(rows)) if d == c}

    rows = sorted(texts(kept))
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = stage["benchmark decontamination"](spark, kept, SMALL)
    assert clean.columns == columns
    assert texts(clean) == {r for r, x in zip(rows, contaminated(rows, items)) if not x[-1]}

    masked = stage["secret scans"](spark, clean, SMALL)
    assert masked.columns == columns and masked.count() == clean.count()
    before = dict(texts(clean))
    for r in masked.collect():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) or secret_scan.MASK in r.text

    final = stage["best-fit packing"](spark, masked, SMALL)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encode.tokenizer_path("byte_bpe_50k.json"))
    rows = sorted(texts(masked))
    ids = dict(zip([d for d, _ in rows], [e.ids + [2] for e in tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]))
    packed([tuple(r) for r in final.collect()], ids)


def test_stages_keep_awkward_rows(spark):
    """Null, empty and repeated rows and extra columns pass the filters; only copies and contaminated texts go."""
    docs = documents(spark, awkward())
    stage = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "benchmark decontamination", "secret scans"):
        out = stage[name](spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() == docs.count()
    assert stage["n-gram Jaccard join"](spark, docs, SMALL).columns == docs.columns
    assert bench_words("Ab-c") == ["ab", "c"]


def test_queries_are_whole(spark):
    """One numbered query for each operator."""
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry_points.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14))


CLASHES = ("_spans", "_text", "_assign", "_access", "_hex", "_markov", "_tokens", "_bench", "_bench_part", "_near_doc_id", "_near_1", "_near_2", "_near_row",
           "_row", "k1", "k2", "c0", "root", "block", "share")


def test_stages_leave_clashing_columns_alone(spark):
    """Columns with the names of helpers come out as they went in, and a text `n_chars` stays one."""
    rows = awkward([(60, "password=abcdefgh12 tail"), (61, None)])
    docs = documents(spark, rows).withColumn("n_chars", F.col("n_chars").cast("string")).select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.schema == docs.schema or [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
        for r in out.collect():
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in CLASHES), name
    masked = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["secret scans"](spark, docs, SMALL).collect()}
    assert masked[60].text == "[SECRET] tail" and masked[60].n_chars == "13" and masked[61].n_chars is None


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    labels, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    for name, docs in (("some", documents(spark, awkward())), ("none", documents(spark, []))):
        where = str(tmp_path / name)
        docs.write.parquet(f"{where}/documents.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        benchmark.write.parquet(f"{where}/benchmark.parquet")
        out = corpus_pipeline.run(spark, where).collect()
        assert all(0 < r.length <= 1024 and r.offset + r.length <= 1024 for r in out)
        assert {r.doc_id for r in out} == ({d for d, *_ in awkward()} - {2, 8, 10, 14} if name == "some" else set())
