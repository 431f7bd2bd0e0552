"""CSV typing, stored tables, synthetic rows."""

import pytest
from pyspark.sql import functions as F

from orrery.session import fresh_path
from orrery.sources import generate as G, load as L, sinks as K


def test_sanitise_name():
    assert L.sanitise_name("  Order Date (UTC) ") == "ORDER_DATE_UTC"
    assert L.sanitise_name("a--b__c") == "A_B_C"


def test_infer_types(spark):
    rows = [("1", "1.5", "2024-01-01", "2024-01-01 10:00", "true", "x" * 300, "", "7", "1"), ("-20", "2", "2024-02-01", "2024-01-01T10:00:05", "0", "y", " ", "", "0")]
    df = spark.createDataFrame(rows, "i string, f string, d string, t string, b string, s string, n string, gaps string, bits string")
    got = {r.column_name: r.inferred_type for r in L.infer_types(df).collect()}
    assert got == {"i": "INTEGER", "f": "FLOAT", "d": "DATE", "t": "TIMESTAMP", "b": "BOOLEAN", "s": "VARCHAR(450)", "n": "VARCHAR(256)", "gaps": "INTEGER", "bits": "BOOLEAN"}


def test_type_beyond_the_first_thousand_rows(spark):
    """Every row counts, not just a sample."""
    df = spark.range(5000).select(F.when(F.col("id") == 4999, "late text").otherwise(F.col("id").cast("string")).alias("v"))
    assert L.infer_types(df).first().inferred_type == "VARCHAR(256)"


def test_load_typed(spark):
    df = spark.createDataFrame([("1", "YES", "2024-01-01", ""), ("x", "f", "", "a")], "i string, b string, d string, s string")
    out = [tuple(r) for r in L.load_typed(df, {"i": "NUMBER(10,0)", "b": "BOOLEAN", "d": "DATE", "s": "VARCHAR(9)"}).collect()]
    assert [(r[0], r[1], str(r[2]), r[3]) for r in out] == [(1, True, "2024-01-01", None), (None, False, "None", "a")]


def test_csv_round_trip_with_line_breaks(spark):
    path = fresh_path(spark, "csv")
    spark.createDataFrame([(1, 'say "hi"\nthere', None), (2, "plain", "z")], "id int, `my text` string, note string").write.csv(f"{path}/My File.csv", header=True, escape='"')
    found = L.scan_csv_dir(spark, path, multi_line=True)
    assert list(found) == ["MY_FILE"]
    assert sorted((r.ID, r.MY_TEXT, r.NOTE) for r in found["MY_FILE"].collect()) == [("1", 'say "hi"\nthere', None), ("2", "plain", "z")]


def test_if_exists(spark):
    df, path = spark.range(3), fresh_path(spark, "table")
    assert L.load_table(df, "stored_once", path=path) == 3
    with pytest.raises(Exception, match="(?i)already exists"):
        L.load_table(df, "stored_once", path=path)
    assert L.load_table(spark.range(9), "stored_once", "skip", path=path) == 3
    assert L.load_table(spark.range(9), "stored_once", "replace", path=path) == 9
    spark.sql("DROP TABLE stored_once")


COLUMNS = [
    {"name": "ID", "type": "INTEGER"}, {"name": "AMOUNT", "type": "FLOAT"}, {"name": "kind", "type": "VARCHAR(9)", "values": ["a", "b", "c"]},
    {"name": "score", "type": "INTEGER", "min": 3, "max": 5}, {"name": "order_date", "type": "DATE"}, {"name": "flag", "type": "BOOLEAN"}, {"name": "seen", "type": "TIMESTAMP"},
]


def test_generate_is_repeatable_and_in_range(spark):
    a = G.generate_table(spark, COLUMNS, 500, seed=42)
    b = G.generate_table(spark, COLUMNS, 500, seed=42).repartition(3)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert G.generate_table(spark, COLUMNS, 500, seed=43).exceptAll(a).count() > 0
    r = a.agg(F.count_distinct("ID").alias("ids"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.min("AMOUNT").alias("al"), F.max("AMOUNT").alias("ah"),
              F.sort_array(F.collect_set("kind")).alias("k"), F.min("order_date").alias("d0"), F.max("order_date").alias("d1")).first()
    assert (r.ids, r.lo, r.hi, r.k) == (500, 3, 5, ["a", "b", "c"])
    assert 1 <= r.al < r.ah <= 10000 and str(r.d0) >= "2023-01-01" and str(r.d1) <= "2025-12-31"


def test_refresh_leaves_other_partitions(spark):
    path = fresh_path(spark, "rollup")
    K.write_rollup(spark.createDataFrame([(1, 10), (2, 20)], "p int, v int"), path, ["p"])
    K.refresh_partitions(spark.createDataFrame([(2, 99), (3, 30)], "p int, v int"), path, ["p"])
    assert sorted((r.p, r.v) for r in spark.read.parquet(path).collect()) == [(1, 10), (2, 99), (3, 30)]


def test_changed_partitions(spark):
    base = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-01'), (2, DATE'2024-01-01'), (3, DATE'2024-01-02') AS b(id, d)")
    assert sorted(r.id for r in K.changed_partitions(base, base.filter("id = 1"), "d").collect()) == [1, 2]


def test_loaded_type(spark):
    """Declared names of other systems."""
    known = {
        "NUMBER(10,0)": "bigint", "number(10, 2)": "double", "NUMERIC": "bigint", "DECIMAL(5,1)": "double", "INTEGER": "bigint", "TINYINT": "bigint",
        "FLOAT": "double", "FLOAT8": "double", "REAL": "double", "DOUBLE PRECISION": "double", "BOOL": "boolean", "BOOLEAN": "boolean", "DATE": "date",
        "DATETIME": "timestamp", "TIMESTAMP_NTZ(9)": "timestamp", "TIMESTAMP": "timestamp", "VARCHAR(20)": "string", "TEXT": "string", "geography": "string",
    }
    assert {k: L.loaded_type(k) for k in known} == known
