"""A corpus pipeline: toxic texts go, one text of each group of near copies stays, contaminated
texts go, secrets are masked, and what is left is packed into sequences.

Every stage but the last returns its rows with the columns it was given, under whatever names, and in
those it does not change with their values and types. Null texts count as empty and pass all filters. Rows are judged one by one, so that repeated
rows share a verdict, except that of equal rows, as of all near copies, one stays. A null doc_id is
no smallest id: such a row is kept beside the class's first. Texts of any length are judged whole. Without
documents all stages give none; without labels of both kinds nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import decontam, jaccard, packing, secret_scan, toxicity
from orrery.llm.common import table, written
from orrery.llm.encode import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under one half. The machine is trained on the given tables; without
    labels of both kinds it scores all with 0. An empty or null text has the score of the bias."""
    machine = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(~(toxicity.score(F.col("text"), machine) >= 0.5))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id; of its repeats any. Texts
    without a word have no copies and all stay, as do the rows of a class in which none has a doc_id."""
    return jaccard.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold too much of the benchmark. An empty benchmark, or one of null texts, keeps all."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and `n_chars`, where there is one, counted anew for
    those. Overlapping secrets get one mask."""
    return secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_samples(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens; an empty or null text is its end id."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

# Training, string kernels and tokenizers have no SQL form: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
