"""Sources and sinks: files written from the given tables are read back, typed and stored."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from orrery.catalogue.registry import query
from orrery.functions import dates as D
from orrery.session import fresh_path
from orrery.sources import generate as G, load as L, sinks as K, tables as S

c = F.col
R = F.round


@query("scan_table", "SELECT o_orderkey, o_totalprice, o_orderdate::DATE AS o_orderdate FROM orders")
def scan_table(t):
    return S.scan_table(t.spark, f"{t.folder}/orders.parquet", {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderdate": "date"})


def csv_folder(t):
    folder = fresh_path(t.spark, "csv")
    t.customer.write.csv(f"{folder}/customer.csv", header=True)
    t.nation.write.csv(f"{folder}/home nations.csv", header=True)
    return folder


@query("scan_csv_dir", "SELECT n_name AS N_NAME, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def scan_csv_dir(t):
    found = L.scan_csv_dir(t.spark, csv_folder(t))
    rows = found["CUSTOMER"].join(found["HOME_NATIONS"], c("C_NATIONKEY") == c("N_NATIONKEY"))
    return rows.groupBy("N_NAME").agg(F.count("*").alias("customers"), R(F.sum(c("C_ACCTBAL").cast("double")), 2).alias("balance"))


@query("scan_manifest", "SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME FROM customer")
def scan_manifest(t):
    folder = csv_folder(t)
    doc = {"tables": [{"table_name": "CUSTOMER", "data_file": f"{folder}/customer.csv"}, {"table_name": "EXTRA", "columns": [{"name": "ID", "type": "INTEGER"}]}]}
    path = f"{folder}/manifest.json"
    t.spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(path)
    return L.scan_manifest(t.spark, path)["CUSTOMER"].select(c("C_CUSTKEY").cast("bigint").alias("C_CUSTKEY"), "C_NAME")


@query("sanitise_columns", 'SELECT p_partkey AS PART_KEY, p_name AS P_NAME, p_size AS SIZE_CM FROM part')
def sanitise_columns(t):
    return L.sanitise_columns(t.part.select(c("p_partkey").alias("part key"), c("p_name").alias("p--name!"), c("p_size").alias(" size (cm)")))


_TYPE = """SELECT '{n}' AS column_name, CASE WHEN count(v) = 0 THEN 'VARCHAR(256)' WHEN bool_and(lower(v) IN ('true', 'false', '0', '1')) THEN 'BOOLEAN'
    WHEN bool_and(regexp_matches(v, '^[+-]?[0-9]+$')) THEN 'INTEGER' WHEN bool_and(regexp_matches(v, '^[+-]?[0-9]+\\.?[0-9]*([eE][+-]?[0-9]+)?$')) THEN 'FLOAT'
    WHEN bool_and(regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) THEN 'DATE' WHEN bool_and(regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}')) THEN 'TIMESTAMP'
    ELSE 'VARCHAR(' || greatest(256, ceil(coalesce(max(length(v)), 0) * 1.5)::BIGINT) || ')' END AS inferred_type, count(v) AS filled
    FROM (SELECT nullif(trim(({e})::VARCHAR), '') AS v FROM {t})"""
_COLS = [("o_orderkey", "o_orderkey"), ("o_totalprice", "o_totalprice"), ("o_orderdate", "o_orderdate"), ("o_orderpriority", "o_orderpriority"),
         ("day", "o_orderdate::DATE"), ("flag", "o_orderkey % 2"), ("blank", "CASE WHEN o_orderkey % 3 = 0 THEN ' ' END")]


@query("infer_types", " UNION ALL ".join(_TYPE.format(n=n, e=e, t="orders") for n, e in _COLS))
def infer_types(t):
    texts = t.orders.select(
        "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", F.to_date("o_orderdate").alias("day"),
        (c("o_orderkey") % 2).alias("flag"), F.when(c("o_orderkey") % 3 == 0, " ").alias("blank"))
    return L.infer_types(texts.select(*[c(n).cast("string").alias(n) for n in texts.columns])).drop("rows")


@query("infer_types_text", " UNION ALL ".join(_TYPE.format(n=n, e=n, t="documents") for n in ("doc_id", "text", "lang", "source", "n_chars")))
def infer_types_text(t):
    return L.infer_types(t.documents).drop("rows")


_SOURCE = {"customer": ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"], "supplier": ["s_suppkey", "s_name", "s_acctbal"]}
_GIVEN = {"Customer": {"C_NAME": "VARCHAR(99)", "c_gone": "DATE"}}


def _report(name, position, column):
    kind = _TYPE.format(n=column, e=column, t=name)
    given = "'VARCHAR(99)'" if column == "c_name" else "inferred_type"
    return f"SELECT '{name}' AS table_name, column_name, {position} AS position, {given} AS type, {column == 'c_name'} AS declared, filled, (SELECT count(*) FROM {name}) AS rows FROM ({kind})"


@query("source_types", " UNION ALL ".join(_report(n, i + 1, x) for n, cols in _SOURCE.items() for i, x in enumerate(cols))
       + " UNION ALL SELECT 'customer', 'c_gone', NULL, 'DATE', true, NULL, NULL")
def source_types(t):
    """Two text tables of a source, one column's type declared, and one declared that is not there."""
    texts = {n: getattr(t, n).select(*[c(x).cast("string").alias(x) for x in cols]) for n, cols in _SOURCE.items()}
    return L.source_types(texts, _GIVEN)


@query("profile_rows", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in ("orders", "customer", "lineitem", "events")))
def profile_rows(t):
    return L.profile_rows({n: getattr(t, n) for n in ("orders", "customer", "lineitem", "events")})


@query("generate_table", """SELECT count(*) AS rows, (max(o_orderkey) + 1)::BIGINT AS last_id, (sum(o_orderkey) + count(*))::BIGINT AS id_sum, 2 AS choices,
    true AS scores_fit, true AS dates_fit, true AS even, true AS again FROM orders""")
def generate_table(t):
    """One synthetic row per order, reduced to what its schema promises: ids, choices, ranges, an even spread, and the same rows again."""
    columns = [
        {"name": "order_id", "type": "INTEGER"}, {"name": "behaviour", "type": "VARCHAR(20)", "values": ["calm", "speeding"]},
        {"name": "score", "type": "FLOAT", "min": 0, "max": 10}, {"name": "customer_name", "type": "VARCHAR"}, {"name": "order_date", "type": "DATE"},
        {"name": "amount", "type": "FLOAT"}, {"name": "qty", "type": "INTEGER"}, {"name": "status", "type": "VARCHAR"}, {"name": "email", "type": "VARCHAR"},
    ]
    made, again = (G.generate_table(t.spark, columns, seed=7, ids=t.orders.select(c("o_orderkey").alias("id"))) for _ in range(2))
    mark = F.sum(F.xxhash64(*made.columns).cast("decimal(38,0)"))
    n = F.count("*")
    return made.agg(
        n.alias("rows"), F.max("order_id").alias("last_id"), F.sum("order_id").alias("id_sum"), F.count_distinct("behaviour").alias("choices"),
        F.bool_and(c("score").between(0, 10)).alias("scores_fit"), F.bool_and(F.year("order_date").between(2023, 2025)).alias("dates_fit"),
        (F.abs(F.count(F.when(c("behaviour") == "calm", 1)) - n / 2) <= 3 * F.sqrt(n / 4)).alias("even"),
        (mark == again.agg(mark.alias("m")).scalar()).alias("again"),
    )


@query("load_table", "SELECT 'replace' AS how, count(*) AS rows FROM orders UNION ALL SELECT 'skip', count(*) FROM orders")
def load_table(t):
    name = f"loaded_{uuid.uuid4().hex}"
    path = fresh_path(t.spark, "loaded")
    first = L.load_table(t.customer, name, path=path)
    second = L.load_table(t.orders, name, if_exists="replace", path=path)
    third = L.load_table(t.customer, name, if_exists="skip")
    t.spark.sql(f"DROP TABLE {name}")
    assert first >= 0
    return t.spark.createDataFrame([("replace", second), ("skip", third)], "how string, rows bigint")


@query("load_typed", "SELECT o_orderkey, o_totalprice, o_orderdate, o_orderdate::DATE AS day, o_orderkey % 2 = 0 AS flag, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS note FROM orders")
def load_typed(t):
    texts = t.orders.select(
        c("o_orderkey").cast("string"), c("o_totalprice").cast("string"), c("o_orderdate").cast("string"), F.to_date("o_orderdate").cast("string").alias("day"),
        F.when(c("o_orderkey") % 2 == 0, "Yes").otherwise("no").alias("flag"), F.when(c("o_orderkey") % 3 == 0, "").otherwise(c("o_orderpriority")).alias("note"))
    return L.load_typed(texts, {"o_orderkey": "INTEGER", "o_totalprice": "FLOAT", "o_orderdate": "TIMESTAMP", "day": "DATE", "flag": "BOOLEAN", "note": "VARCHAR(256)"})


@query("sql_view", "SELECT o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) WHERE n > 10")
def sql_view(t):
    view = S.sql_view(t.spark, "filled_orders", "SELECT o_orderpriority, count(*) AS n FROM src_orders WHERE o_orderstatus = 'F' GROUP BY 1", {"src_orders": t.orders})
    return view.filter("n > 10")


AGG = "(SELECT o_custkey, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)"
agg = lambda t: S.agg_view(t.orders, ["o_custkey", "o_orderstatus"], {"n": F.count("*"), "total": R(F.sum("o_totalprice"), 2)})


@query("agg_view", f"SELECT o_orderstatus, max(n) AS most, count(*) AS customers FROM {AGG} GROUP BY 1")
def agg_view(t):
    return agg(t).groupBy("o_orderstatus").agg(F.max("n").alias("most"), F.count("*").alias("customers"))


@query("view_on_view", f"SELECT o_orderstatus, round(sum(total) / sum(n), 4) AS per_order FROM {AGG} WHERE n >= 3 GROUP BY 1")
def view_on_view(t):
    busy = agg(t).filter("n >= 3")
    return S.agg_view(busy, ["o_orderstatus"], {"per_order": R(F.try_divide(F.sum("total"), F.sum("n")), 4)})


ROLL = "SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {t} GROUP BY 1, 2"
monthly = lambda df: df.groupBy(D.date_bucket(c("o_orderdate"), "MONTHLY").alias("month"), "o_orderstatus").agg(
    F.count("*").alias("n"), R(F.sum("o_totalprice"), 2).alias("total"))


@query("write_rollup", ROLL.format(t="orders"))
def write_rollup(t):
    path = fresh_path(t.spark, "rollup")
    K.write_rollup(monthly(t.orders), path, ["month"])
    return t.spark.read.parquet(path).select("month", "o_orderstatus", "n", "total")


@query("rollup_refresh_partition", ROLL.format(t="(SELECT o_orderstatus, o_orderdate, CASE WHEN o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1998 THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM orders)"))
def rollup_refresh_partition(t):
    """A rollup is written, orders of one year are corrected, and only their months are written again."""
    path = fresh_path(t.spark, "rollup")
    K.write_rollup(monthly(t.orders), path, ["month"])
    wrong = (c("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 1998)
    base = t.orders.withColumn("o_totalprice", F.when(wrong, 1.0).otherwise(c("o_totalprice")))
    month = D.date_bucket(c("o_orderdate"), "MONTHLY")
    touched = base.filter(wrong).select(month.alias("_m")).distinct()
    K.refresh_partitions(monthly(base.join(touched, month == c("_m"), "left_semi")), path, ["month"])
    return t.spark.read.parquet(path).select("month", "o_orderstatus", "n", "total")
