"""Data audits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalogue.registry import query
from orrery.operators import audit as A

c = F.col
R = F.round


@query("audit_fan_out", """SELECT (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey) AS rows_after,
    (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys, true AS multiplies""")
def audit_fan_out(t):
    return A.fan_out(t.orders, "o_orderkey", t.lineitem, "l_orderkey")


@query("audit_key_uniqueness", "SELECT 'order' AS key, count(*) AS rows, count(DISTINCT o_orderkey) AS keys, 1 AS max_per_key, true AS is_unique FROM orders UNION ALL SELECT 'line', sum(n)::BIGINT, count(*), max(n), sum(n) = count(*) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def audit_key_uniqueness(t):
    one = A.key_uniqueness(t.orders, ["o_orderkey"]).select(F.lit("order").alias("key"), "*")
    return one.unionByName(A.key_uniqueness(t.lineitem, ["l_orderkey", "l_linenumber"]).select(F.lit("line").alias("key"), "*"))


_ORPHAN = "SELECT '{n}' AS join, count(*) AS orphan_rows, count(DISTINCT {ak}) AS orphan_keys FROM {a} WHERE {ak} NOT IN (SELECT {bk} FROM {b})"


@query("audit_orphans", " UNION ALL ".join(_ORPHAN.format(n=n, a=a, ak=ak, b=b, bk=bk) for n, a, ak, b, bk in (
    ("orders without lines", "orders", "o_orderkey", "lineitem", "l_orderkey"), ("documents without labels", "documents", "doc_id", "labels", "doc_id"),
    ("lines without parts", "lineitem", "l_partkey", "part", "p_partkey"))))
def audit_orphans(t):
    return A.orphans({
        "orders without lines": (t.orders, "o_orderkey", t.lineitem, "l_orderkey"), "documents without labels": (t.documents, "doc_id", t.labels, "doc_id"),
        "lines without parts": (t.lineitem, "l_partkey", t.part, "p_partkey")})


@query("audit_join_key_types", "SELECT 'customer to nation' AS join, 'int' AS left_type, 'int' AS right_type, false AS types_differ, false AS text_key, true AS all_numbers UNION ALL SELECT 'orders to text keys', 'bigint', 'string', true, true, bool_and(TRY_CAST(split_part(c_name, '#', 2) AS BIGINT) IS NOT NULL) FROM customer")
def audit_join_key_types(t):
    texts = t.customer.select(F.split_part("c_name", F.lit("#"), F.lit(2)).alias("k"))
    return A.join_key_types({"customer to nation": (t.customer, "c_nationkey", t.nation, "n_nationkey"), "orders to text keys": (t.orders, "o_custkey", texts, "k")})


@query("audit_grain", "SELECT count(*) AS rows, 11 AS columns, 7 AS attributes, round(7 / 11.0, 6)::DOUBLE AS attribute_share, true AS flagged FROM lineitem")
def audit_grain(t):
    return A.grain(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn("attribute_share", R("attribute_share", 6))


_CARD = "SELECT '{n}' AS column_name, count(*) AS rows, count(DISTINCT {n}) AS distinct_values, round(count(DISTINCT {n}) / count(*)::DOUBLE, 6) AS ratio FROM orders"


@query("audit_cardinality", " UNION ALL ".join(_CARD.format(n=n) for n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def audit_cardinality(t):
    return A.cardinality(t.orders, exact=True).withColumn("ratio", R("ratio", 6))


@query("audit_cardinality_sketch", " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(*) AS rows, count(DISTINCT {n}) AS distinct_values, true AS within FROM orders"
    for n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def audit_cardinality_sketch(t):
    """One pass of sketches over every column beside the exact counts: are they within 6 %?"""
    near = A.cardinality(t.orders).select("column_name", c("distinct_values").alias("_near"))
    both = A.cardinality(t.orders, exact=True).join(near, "column_name")
    within = F.abs(c("_near") - c("distinct_values")) <= 0.06 * c("distinct_values")
    return both.select("column_name", "rows", "distinct_values", within.alias("within"))


# Three tables that hold customers' keys.
_KEYS = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id"}
_ONE = "(SELECT DISTINCT {c} FROM {t})"


def _pair(a, b):
    x, y = _ONE.format(t=a, c=_KEYS[a]), _ONE.format(t=b, c=_KEYS[b])
    s, e = f"(SELECT count(*) FROM ({x} INTERSECT {y}))", f"(SELECT count(*) FROM ({x} UNION {y}))"
    return f"SELECT '{a}' AS left_table, '{b}' AS right_table, {s} AS shared, {e} AS either, round({s} / {e}::DOUBLE, 6) AS jaccard, {s} / {e}::DOUBLE > 0.5 AS flagged"


@query("audit_overlap", " UNION ALL ".join(_pair(a, b) for a, b in (("customer", "orders"), ("customer", "events"), ("orders", "events"))))
def audit_overlap(t):
    return A.column_overlap({n: getattr(t, n).select(k) for n, k in _KEYS.items()}).withColumn("jaccard", R("jaccard", 6))


@query("audit_duplicates", "SELECT 'customer, customer_copy' AS tables, count(*) AS rows FROM customer")
def audit_duplicates(t):
    return A.duplicates({
        "customer": t.customer, "customer_copy": t.customer.select(*t.customer.columns),
        "customer_changed": t.customer.withColumn("c_acctbal", F.when(c("c_custkey") == 3, 0.0).otherwise(c("c_acctbal"))), "supplier": t.supplier})


@query("audit_conformed_dims", """SELECT count(*) FILTER (c IS NOT NULL AND s IS NOT NULL) AS shared, count(*) FILTER (s IS NULL) AS left_only, count(*) FILTER (c IS NULL) AS right_only,
    round(count(*) FILTER (c IS NULL OR s IS NULL) / count(*)::DOUBLE, 6) AS one_sided_share FROM (SELECT DISTINCT o_custkey AS c FROM orders) FULL JOIN (SELECT DISTINCT user_id AS s FROM events) ON c = s""")
def audit_conformed_dims(t):
    return A.conformed_dims(t.orders, "o_custkey", t.events, "user_id").withColumn("one_sided_share", R("one_sided_share", 6))


@query("audit_pii_columns", "SELECT 'people' AS table_name, n AS column_name, k AS category, l AS confidence, (SELECT count(*) FROM customer) AS filled FROM (VALUES ('email_addr', 'email', 'HIGH'), ('mobile', 'phone', 'HIGH'), ('full_name', 'person_name', 'MEDIUM'), ('zip_code', 'address', 'MEDIUM')) v(n, k, l)")
def audit_pii_columns(t):
    people = t.customer.select("c_custkey", c("c_name").alias("full_name"), c("c_name").alias("email_addr"), c("c_custkey").alias("mobile"), c("c_nationkey").alias("zip_code"))
    return A.pii_columns({"people": people, "orders": t.orders})


# The same patterns in the other engine's dialect; both are whole-text searches.
_V = {"email": A.PII_VALUES["email"], "phone": A.PII_VALUES["phone"], "national_id": A.PII_VALUES["national_id"], "dob": A.PII_VALUES["dob"],
      "financial": A.PII_VALUES["financial"], "person_name": A.PII_VALUES["person_name"], "address": A.PII_VALUES["address"]}


@query("audit_pii_values", " UNION ALL ".join(f"SELECT 'text' AS column_name, '{k}' AS category, count(*) FILTER (regexp_matches(text, '{p}')) AS rows FROM documents" for k, p in _V.items()))
def audit_pii_values(t):
    return A.pii_values(t.documents, ["text"])


@query("audit_secrets", f"SELECT 'text' AS column_name, count(*) FILTER (regexp_matches(text, '{A.SECRET_WORDS}')) AS rows, false AS name_hit FROM documents")
def audit_secrets(t):
    return A.secrets(t.documents, ["text"])


@query("audit_date_constraint", "SELECT 'orders' AS fact, min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date, date_diff('day', min(o_orderdate), max(o_orderdate)) AS days, date_diff('day', min(o_orderdate), max(o_orderdate)) > 730 AS unbounded FROM orders UNION ALL SELECT 'events', min(ts)::DATE, max(ts)::DATE, date_diff('day', min(ts), max(ts)), date_diff('day', min(ts), max(ts)) > 730 FROM events")
def audit_date_constraint(t):
    return A.date_span({"orders": (t.orders, "o_orderdate"), "events": (t.events, "ts")}, 730)


@query("parity_totals", """SELECT y, a.n AS n_a, b.n AS n_b, a.n IS NOT DISTINCT FROM b.n AS agrees FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) a
    FULL JOIN (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1) b USING (y)""")
def parity_totals(t):
    shipped = t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"), "left_semi")
    year = lambda df: df.withColumn("y", F.year("o_orderdate"))
    return A.parity(year(t.orders), year(shipped), ["y"], {"n": F.count("*")})
