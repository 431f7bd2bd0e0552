import pytest
from pyspark.sql import functions as F

from orrery.operators import joins as J


def by_pair(df):
    return {(r.source_table, r.source_column, r.target_table, r.target_column): (r.target_rows, r.target_keys, r.max_rows_per_key, r.cardinality, r.inclusion) for r in df.collect()}


def brute(tables):
    """The figures of every pair of equally named columns, from plain sets."""
    from collections import Counter

    held = {(t, c): Counter(str(r[c]) for r in df.select(c).collect() if r[c] is not None) for t, df in tables.items() for c in df.columns}
    out = {}
    for (s, sc), a in held.items():
        for (t, tc), b in held.items():
            if s != t and sc.lower() == tc.lower() and sum(b.values()) == len(b):
                most = max(a.values(), default=None)
                out[s, sc, t, tc] = (len(b), len(b), most, "ONE_TO_ONE" if most == 1 else "MANY_TO_ONE", len(a.keys() & b.keys()) / len(a) if a else None)
    return out


def test_pairs_against_plain_sets(spark):
    tables = {
        "many": spark.createDataFrame([(1, "a", 1.5, None), (1, "b", 2.5, None), (2, None, None, None), (None, "c", 9.0, None)], "id int, code string, x double, none string"),
        "one": spark.createDataFrame([(1, "a", 100.0, "p"), (2, "b", 200.0, "q"), (3, "z", 300.0, "r")], "id long, code string, X double, none string"),
        "text": spark.createDataFrame([("1", "10"), ("7", "20")], "id string, code string"),
    }
    got = by_pair(J.discover_joins(tables))
    assert got == brute(tables)
    with pytest.raises(ValueError, match="share"):
        J.discover_joins({"a": tables["one"].select("id"), "b": tables["one"].select("code")})


def test_large_keys_are_joined_exactly(spark, monkeypatch):
    """Beyond what a sketch holds, the shared keys are counted by a join; ranges that lie apart need none."""
    monkeypatch.setattr(J, "SKETCH_BITS", 5)
    ids = lambda a, b, step=1: spark.range(a, b, step).toDF("id")
    tables = {"a": ids(0, 4000), "b": ids(0, 9000, 3), "far": ids(100_000, 101_000), "few": ids(5, 8)}
    got = by_pair(J.discover_joins(tables))
    assert got == brute(tables)
    assert got["a", "id", "far", "id"][4] == 0 and got["few", "id", "a", "id"][4] == 1
    # The result reads written keys and figures, no table again.
    assert "Range (" not in J.discover_joins(tables)._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark):
    one = spark.createDataFrame([(1,)], "id int")
    got = by_pair(J.discover_joins({"a": one, "b": one.where(F.lit(False))}))
    assert got[("a", "id", "b", "id")][4] == 0 and got[("b", "id", "a", "id")][4] is None
