"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Words end at ASCII white space. Counts of a text are columns (COUNTS); each rule of RULES is a
ratio of two of them and the bounds it must keep; a text with a zero denominator passes the rule.
The rules are plain arithmetic, so the same table also makes the SQL that checks the result.

Repeated words are found inside each text: 8-word windows are hashed, a text with equal hashes
sorts them with their places, and places of windows found twice cover their words. Nothing is
shuffled. Null texts have no words and fail the base rule; repeated rows are judged each for
itself; extra columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.common import built_once

WINDOW = 8
# Usual function words of the four languages, in lower case.
STOP_WORDS = {
    "en": "the and of to in a is that it was for on are with as be this by from at or",
    "fr": "le la les de des du et un une en est que qui dans pour par sur pas au avec",
    "de": "der die das und den von zu mit sich ist im dem nicht ein eine als auch es an auf",
    "es": "el los las de del y que en la un una por con no se su para es al lo",
}
# name, numerator, denominator, least, most
RULES = [
    ("mean_word_length", "word_chars", "n_words", 1.5, 20),
    ("symbols_a_word", "n_symbols", "n_words", 0, 0.3),
    ("stop_words", "n_stop_words", "n_words", 0.02, 1),
    ("repeated_lines", "n_dup_lines", "n_lines", 0, 0.5),
    ("shouted_words", "n_shouted", "n_words", 0, 0.5),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", 0, 0.5),
    ("bullet_lines", "n_bullet_lines", "n_lines", 0, 0.9),
]
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def compiled(rules=RULES) -> str:
    """All rules as one SQL condition."""
    return " AND ".join(
        f"({b} = 0 OR ({a} >= {low} * {b} AND {a} <= {high} * {b}))" for _, a, b, low, high in rules
    )


def stop_words() -> list[str]:
    return sorted({w for words in STOP_WORDS.values() for w in words.split()})


def _size(c: Column) -> Column:
    return F.size(c).cast("long")


def _repeated(docs: DataFrame) -> DataFrame:
    """_repeat: words in windows that occur twice or more, from the words' hashes in _hashes."""
    windows = F.when(F.size("_hashes") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW))
    ))
    docs = docs.withColumn("_windows", windows)
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(twice, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    docs = docs.withColumn("_sorted", placed)
    rest = F.size("_sorted") - 1
    equal = F.zip_with(F.slice("_sorted", 1, rest), F.slice("_sorted", 2, rest), lambda a, b: a["h"] == b["h"])
    docs = docs.withColumn("_equal", F.when(F.col("_sorted").isNotNull(), equal))
    no = F.array(F.lit(False))
    either = F.zip_with(F.concat(no, "_equal"), F.concat("_equal", no), lambda a, b: a | b)
    places = F.zip_with("_sorted", either, lambda s, d: F.when(d, s["at"]))
    starts = F.sort_array(F.filter(places, lambda p: p.isNotNull()))
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return docs.withColumn("_repeat", F.when(F.col("_sorted").isNotNull(), covered).otherwise(F.lit(0).cast("long")))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("_text"))
    docs = docs.withColumn("_words", F.filter(F.split("_text", "[ \\t-\\r]+"), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split("_text", "\\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    )
    docs = _repeated(docs.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))))
    lines = lambda pattern: _size(F.filter("_lines", lambda line: line.rlike(pattern)))
    return built_once(docs, {
        "n_words": _size(F.col("_words")), "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": _size(F.col("_lines")) - _size(F.array_distinct("_lines")),
        "n_repeat_words": F.col("_repeat"), "n_lines": _size(F.col("_lines")),
        "n_stop_words": _size(F.filter("_words", lambda w: F.lower(w).isin(stop_words()))),
        "n_shouted": F.regexp_count("_text", F.lit("[A-Z][A-Z]+")).cast("long"),
        "n_ellipsis_lines": lines("(\\.\\.\\.|…)[ \\t-\\r]*$"), "n_bullet_lines": lines("^[ \\t]*[-*•]"),
    }).drop("_text", "_words", "_lines", "_hashes", "_windows", "_sorted", "_equal", "_repeat")


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """All counts, base_failed and kept for every row."""
    out = counts(docs).withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", F.expr(f"NOT base_failed AND {compiled(rules)}"))


SPACES = "[ \\t\\n\\x0B\\f\\r]"
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
  FROM d, unnest(range(1, len(words) - {WINDOW - 2})) AS r(i)
), dup AS (
  SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1
), cover AS (
  SELECT doc_id, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - {WINDOW})) AS n
  FROM win JOIN dup USING (doc_id, g)
), rep AS (
  SELECT doc_id, sum(n)::bigint AS n_repeat_words FROM cover GROUP BY doc_id
), c AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda x: list_contains([{", ".join(f"'{w}'" for w in stop_words())}], lower(x)))) AS n_stop_words,
    len(regexp_extract_all(text, '[A-Z][A-Z]+')) AS n_shouted,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…){SPACES}*$'))) AS n_ellipsis_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ \\t]*[-*•]'))) AS n_bullet_lines
  FROM d LEFT JOIN rep USING (doc_id)
), b AS (SELECT *, {BASE_FAILED} AS base_failed FROM c)
SELECT *, NOT base_failed AND {compiled()} AS kept FROM b
"""
