"""URL filters: given rules, and association rules that FP-growth mines from what those label.

A given rule is (verdict, host, path): it fits its host and all subdomains if the url's path starts
with the rule's, and the longest one wins. Urls that a rule fits are the labelled ones: their
tokens and verdict make FP-growth's baskets. Token combinations that imply `block` with enough
support and confidence are the mined rules, without those that hold all of a smaller one. They are matched by an inverted index: a join of each
other url's tokens with the tokens of the rules, and a rule fires where all its tokens are met.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: on to `?`, `#` or the
end. A null url, or one without `://`, has both empty, no rule, and is allowed. Repeated rows are
judged each for itself; extra columns are not read; without labelled urls of both kinds
nothing is mined, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.common import written

# The contract's rules: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SUPPORT, CONFIDENCE = 0.01, 0.9
BLOCK, ALLOW = "=block", "=allow"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def given(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens of host and path; the ones that are numbers are left out."""
    words = F.split(F.lower(F.concat_ws("/", host, path)), "[^\\p{L}0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$")))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule_id, token, size): an inverted index of token sets that imply `block`, from (tokens, verdict)."""
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(
        (F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK) & (F.size("antecedent") > 0)
        & ~F.array_contains("antecedent", ALLOW)
    ).select(F.array_join(F.array_sort("antecedent"), " ").alias("rule_id"), "antecedent")
    index = written(
        rules.select("rule_id", F.explode("antecedent").alias("token"), F.size("antecedent").alias("size")), "url-rules"
    )
    # A rule that holds all of a smaller one's tokens never fires without it: the smaller says it all.
    small = index.select(F.col("rule_id").alias("inner"), "token", F.col("size").alias("inner_size"))
    spare = index.join(small, "token").where("inner_size < size").groupBy("rule_id", "inner", "inner_size") \
        .agg(F.count(F.lit(1)).alias("n")).where("n = inner_size").select("rule_id").distinct()
    return index.join(spare, "rule_id", "left_anti")


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages`; mined says which mined rule blocks."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = given(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "given": verdict, "tokens": tokens_of(F.col("host"), F.col("path"))})
    index = mine(rows.where("rule IS NOT NULL").select("tokens", F.col("given").alias("verdict")), support, confidence)
    # Equal hosts and paths are judged once: the index never meets a hot url more than once.
    other = rows.where("rule IS NULL AND size(tokens) > 0").select("host", "path", "tokens").distinct()
    met = other.select("host", "path", F.explode("tokens").alias("token")).join(index, "token")
    fired = met.groupBy("host", "path", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).where("n = size") \
        .groupBy("host", "path").agg(F.min("rule_id").alias("mined"))
    named = rows.where("rule IS NULL").drop("tokens").join(fired, ["host", "path"], "left")
    block = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return rows.where("rule IS NOT NULL").select(
        "page_id", "host", "path", "rule", F.col("given").alias("verdict"), F.lit(None).cast("string").alias("mined")
    ).unionAll(named.select("page_id", "host", "path", "rule", block.alias("verdict"), "mined"))
