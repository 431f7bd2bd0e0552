"""Data audits: fan-out, keys, orphans, grain, overlap, duplicates, sensitive values, parity.

Each audit returns a small frame of findings. Scans are grouped with partial
aggregation; no rows reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from orrery.operators.joins import drill_across
from orrery.operators.keys import join_on


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def key_uniqueness(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, the most rows of one key, and whether the key is unique."""
    return df.groupBy(*key).agg(F.count("*").alias("_n")).agg(
        F.sum("_n").alias("rows"), F.count("*").alias("keys"), F.max("_n").alias("max_per_key")
    ).withColumn("is_unique", F.col("rows") == F.col("keys"))


def fan_out(many: DataFrame, many_key: str, one: DataFrame, one_key: str) -> DataFrame:
    """Rows of `many` before and after a left join to `one`, counted from key totals alone."""
    left = many.groupBy(F.col(many_key).alias("_k")).agg(F.count("*").alias("_l"))
    right = one.groupBy(F.col(one_key).alias("_o")).agg(F.count("*").alias("_r"))
    per_key = left.join(right, F.col("_k") == F.col("_o"), "left")
    return per_key.agg(
        F.sum("_l").alias("rows_before"),
        F.sum(F.col("_l") * F.coalesce(F.col("_r"), F.lit(1))).alias("rows_after"),
        F.count(F.when(F.col("_r") > 1, 1)).alias("repeated_keys"),
    ).withColumn("multiplies", F.col("rows_after") > F.col("rows_before"))


def orphans(joins: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per join, rows and keys of the first side without a partner on the second."""
    out = []
    for name, (a, ak, b, bk) in joins.items():
        lost = a.join(b.select(F.col(bk).alias("_o")), F.col(ak) == F.col("_o"), "left_anti")
        out.append(lost.groupBy(ak).agg(F.count("*").alias("_n")).agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows"), F.count("*").alias("orphan_keys")
        ).select(F.lit(name).alias("join"), "orphan_rows", "orphan_keys"))
    return _stack(out)


def join_key_types(joins: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per join, both key types, whether they differ or are text, and text keys that are all numbers."""
    out = []
    for name, (a, ak, b, bk) in joins.items():
        ta, tb = a.schema[ak].dataType.simpleString(), b.schema[bk].dataType.simpleString()
        numeric = lambda k: F.bool_and(F.col(k).cast("string").try_cast("bigint").isNotNull() | F.col(k).isNull())
        ca, cb = a.agg(numeric(ak).alias("a")), b.agg(numeric(bk).alias("b"))
        out.append(join_on(ca, cb, []).select(
            F.lit(name).alias("join"), F.lit(ta).alias("left_type"), F.lit(tb).alias("right_type"),
            F.lit(ta != tb).alias("types_differ"), F.lit("string" in (ta, tb)).alias("text_key"),
            (F.col("a") & F.col("b")).alias("all_numbers"),
        ))
    return _stack(out)


def distinct_ratios(df: DataFrame, exact: bool = False) -> DataFrame:
    """Distinct values of every column over the rows: in one pass of sketches, or exactly.

    Exact counts group each column by itself, which reads every column once and combines repeated values in
    each task; no row is repeated for each column.
    """
    if exact:
        grouped = [df.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n")).agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.lit(c).alias("column_name"), F.count("_v").alias("distinct_values")) for c in df.columns]
        counted = _stack(grouped)
    else:
        one = df.agg(F.count("*").alias("rows"), *[F.approx_count_distinct(F.col(c), 0.02).alias(f"c{i}") for i, c in enumerate(df.columns)])
        counted = one.select("rows", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("distinct_values")) for i, c in enumerate(df.columns)])))
    return counted.withColumn("ratio", F.try_divide(F.col("distinct_values").cast("double"), F.col("rows")))


cardinality = distinct_ratios


def grain(df: DataFrame, measures: Sequence[str], limit: float = 0.4) -> DataFrame:
    """Share of a fact's columns that are attributes, and whether it is over the limit."""
    attributes = [c for c in df.columns if c not in measures]
    share = len(attributes) / len(df.columns)
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(len(attributes)).alias("attributes"),
        F.lit(share).alias("attribute_share"), F.lit(share > limit).alias("flagged"),
    )


def column_overlap(tables: Mapping[str, DataFrame], limit: float = 0.5) -> DataFrame:
    """Pairs of tables whose value sets of one column overlap: Jaccard of distinct values.

    Values of all tables are listed once and grouped by value; a value held by k tables
    adds to the pairs of those k tables only, so the work is bounded by tables squared
    per value, not by rows squared.
    """
    names = list(tables)
    held = _stack([df.select(F.col(df.columns[0]).cast("string").alias("v")).distinct().withColumn("t", F.lit(n)) for n, df in tables.items()])
    marks = held.groupBy("v").agg(*[F.max(F.when(F.col("t") == n, 1)).alias(f"h{i}") for i, n in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    one = marks.agg(*[
        f for i, j in pairs for f in (
            F.count(F.when(F.col(f"h{i}").isNotNull() & F.col(f"h{j}").isNotNull(), 1)).alias(f"b{i}_{j}"),
            F.count(F.when(F.col(f"h{i}").isNotNull() | F.col(f"h{j}").isNotNull(), 1)).alias(f"e{i}_{j}"))
    ])
    rows = F.array(*[F.struct(
        F.lit(names[i]).alias("left_table"), F.lit(names[j]).alias("right_table"),
        F.col(f"b{i}_{j}").alias("shared"), F.col(f"e{i}_{j}").alias("either")) for i, j in pairs])
    return one.select(F.inline(rows)).withColumn("jaccard", F.try_divide(F.col("shared").cast("double"), F.col("either"))).withColumn(
        "flagged", F.coalesce(F.col("jaccard") > limit, F.lit(False)))


def content_hash(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count and an order-free content hash per table; equal pairs hold the same data.

    The sum of row hashes is kept as a decimal, so it cannot overflow.
    """
    def one(n: str, df: DataFrame) -> DataFrame:
        row = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(20,0)")
        return df.agg(F.count("*").alias("rows"), F.sum(row).alias("hash")).select(F.lit(n).alias("table_name"), "rows", F.col("hash").cast("string").alias("hash"))

    return _stack([one(n, df) for n, df in tables.items()])


def duplicates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Groups of tables with the same content."""
    h = content_hash(tables)
    return h.groupBy("rows", "hash").agg(F.array_join(F.array_sort(F.collect_list("table_name")), ", ").alias("tables"), F.count("*").alias("copies")).filter("copies > 1").select("tables", "rows")


def conformed_dims(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """Distinct values of a column in two tables: shared, on one side only, and the share of those."""
    left = a.select(F.col(a_col).alias("v")).distinct().withColumn("l", F.lit(1))
    right = b.select(F.col(b_col).alias("v")).distinct().withColumn("r", F.lit(1))
    both = drill_across([left, right], ["v"])
    return both.agg(
        F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("shared"),
        F.count(F.when(F.col("r").isNull(), 1)).alias("left_only"),
        F.count(F.when(F.col("l").isNull(), 1)).alias("right_only"),
    ).withColumn("one_sided_share", F.try_divide((F.col("left_only") + F.col("right_only")).cast("double"), F.col("shared") + F.col("left_only") + F.col("right_only")))


# Words in column names by which a category of personal data is recognised.
PII_NAMES = {
    "email": (r"e[-_]?mail|email[-_]?addr", "HIGH"),
    "phone": (r"phone|mobile|cell[-_]?phone|fax|tel(?:ephone)?", "HIGH"),
    "national_id": (r"ssn|social[-_]?sec|national[-_]?id|tax[-_]?id|nin\b|sin\b", "HIGH"),
    "dob": (r"dob|birth[-_]?date|date[-_]?of[-_]?birth|birthday", "HIGH"),
    "financial": (r"credit[-_]?card|card[-_]?num|account[-_]?num|iban|routing[-_]?num", "HIGH"),
    "person_name": (r"first[-_]?name|last[-_]?name|surname|full[-_]?name|given[-_]?name", "MEDIUM"),
    "address": (r"street[-_]?addr|postal[-_]?code|zip[-_]?code", "MEDIUM"),
}
SECRET_WORDS = r"(?i)\bpassword\b|\bpasswd\b|\bsecret[-_]?key\b|\bapi[-_]?key\b|\btoken\b"

# Patterns of values, our counterpart of the name patterns. They only have to find that a
# value is there, so none starts with a repeat that would be tried from every character.
PII_VALUES = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2}",
    "phone": r"\d{3}\)?[ -]\d{3}[ -]\d{4}",
    "national_id": r"\b\d{3}-\d{2}-\d{4}\b",
    "dob": r"(?i)\b(born|dob|birth ?date)\b[^0-9]{0,12}\d{1,4}[-/.]\d{1,2}[-/.]\d",
    "financial": r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b|\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "person_name": r"(?i)\b(first|last|full|given) ?name\b ?[:=]",
    "address": r"(?i)\b(postal|zip) ?code\b ?[:=]? ?[0-9A-Z]{4,7}",
}


def name_category(name: str) -> tuple[str, str] | None:
    """The first category whose words occur in a column name, with its confidence."""
    return next(((k, level) for k, (p, level) in PII_NAMES.items() if re.search(p, name, re.I)), None)


def pii_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns whose names suggest personal data, with the filled rows at stake."""
    out = []
    for n, df in tables.items():
        for c in df.columns:
            hit = name_category(c)
            if hit:
                out.append(df.agg(F.count(F.col(c)).alias("filled")).select(
                    F.lit(n).alias("table_name"), F.lit(c).alias("column_name"), F.lit(hit[0]).alias("category"), F.lit(hit[1]).alias("confidence"), "filled"))
    if not out:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table_name string, column_name string, category string, confidence string, filled bigint")
    return _stack(out)


def pii_values(df: DataFrame, columns: Sequence[str], patterns: Mapping[str, str] | None = None) -> DataFrame:
    """Rows per text column and category whose whole text holds a value of that pattern; one scan."""
    found = patterns or PII_VALUES
    pairs = [(c, k) for c in columns for k in found]

    def hit(c: str, k: str) -> Column:
        # No text without an '@' holds an address; that much is cheaper to see.
        found_ = F.col(c).rlike(found[k])
        return F.col(c).contains("@") & found_ if k == "email" else found_

    one = df.agg(*[F.count(F.when(hit(c, k), 1)).alias(f"n{i}") for i, (c, k) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("category"), F.col(f"n{i}").alias("rows")) for i, (c, k) in enumerate(pairs)])
    return one.select(F.inline(rows))


def secrets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per text column that hold credential words, and whether the name itself does."""
    return pii_values(df, columns, {"secret": SECRET_WORDS}).select(
        "column_name", F.col("rows"), F.col("column_name").rlike(SECRET_WORDS).alias("name_hit"))


def date_span(facts: Mapping[str, tuple[DataFrame, str]], limit_days: int) -> DataFrame:
    """First and last date per fact, the span, and whether it calls for a date constraint."""
    return _stack([
        df.agg(F.to_date(F.min(d)).alias("first_date"), F.to_date(F.max(d)).alias("last_date")).select(F.lit(n).alias("fact"), "first_date", "last_date")
        for n, (df, d) in facts.items()
    ]).withColumn("days", F.date_diff("last_date", "first_date")).withColumn("unbounded", F.col("days") > limit_days)


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], tolerance: float = 1e-9) -> DataFrame:
    """Both sources grouped to the same grain: values side by side and whether they agree."""
    left = a.groupBy(*keys).agg(*[m.alias(f"{n}_a") for n, m in measures.items()])
    right = b.groupBy(*keys).agg(*[m.alias(f"{n}_b") for n, m in measures.items()])
    both = drill_across([left, right], keys)
    same = F.lit(True)
    for n in measures:
        x, y = F.col(f"{n}_a").cast("double"), F.col(f"{n}_b").cast("double")
        near = F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
        same = same & F.coalesce(near, x.eqNullSafe(y))
    return both.withColumn("agrees", same)
