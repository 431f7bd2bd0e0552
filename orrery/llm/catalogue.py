"""The numbered queries over whole tables, and the SQL that they must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import decontam, html_text, jaccard, oracles, packing, quality, secret_scan, substring, token_counts, tokens, toxicity, url_rules, vector_codes, whitening
from orrery.llm.common import table
from orrery.llm.encode import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from wavelet-matrix files."""
    return tokens.tokenized(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at five words and a similarity of 0.8 or more."""
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found in every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules for every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


ORACLES["op5_quality_rules"] = quality.ORACLE


@query
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page."""
    return url_rules.judge(table(spark, sf_dir, "pages"))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that smaller documents also have."""
    return substring.dedup(table(spark, sf_dir, "documents"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and the errors of every vector, with the digest of the codebooks."""
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.counted(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


ORACLES["op1_substring_dedup"] = oracles.SUBSTRING
ORACLES["op8_decontamination"] = oracles.DECONTAMINATION
ORACLES["op11_vector_codes"] = oracles.lloyd(vector_codes.ROUNDS)
