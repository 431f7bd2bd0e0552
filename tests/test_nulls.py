"""Groups without values, exact types, and refusals."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from orrery.operators import aggregates as A, joins as J, security as Y, timeintel as T


@pytest.fixture(scope="module")
def gaps(spark):
    big = 9007199254740993
    return spark.createDataFrame([("a", 1), ("a", 1), ("a", big), ("b", None), ("b", None), (None, 3), ("c", 2), ("c", None)], "g string, v long")


def test_groups_without_values_stay(gaps):
    assert rows(A.mode(gaps, ["g"], "v", "m")) == rows(gaps.sparkSession.createDataFrame([("a", 1), ("b", None), (None, 3), ("c", 2)], "g string, m long"))
    lists = {r.g: r.s for r in A.string_list(gaps.withColumn("v", F.col("v").cast("string")), ["g"], "v", "s").collect()}
    assert lists["b"] is None and lists["c"] == "2"
    assert {r.g: r.x for r in A.nth_by_value(gaps, ["g"], "v", 2, "x").collect()} == {"a": 1, "b": None, None: None, "c": None}
    found = {r.g: (r.p, r.d) for r in A.percentiles(gaps, ["g"], "v", {"p": (0.5, "cont"), "d": (0.5, "disc")}).collect()}
    assert found == {"a": (1.0, 1.0), "b": (None, None), None: (3.0, 3.0), "c": (2.0, 2.0)}


def test_discrete_percentiles_keep_the_type(gaps):
    assert {r.g: r.d for r in A.percentiles(gaps, ["g"], "v", {"d": (1.0, "disc")}).collect()}["a"] == 9007199254740993


def test_percentile_of_nothing(gaps):
    assert A.percentiles(gaps.limit(0), [], "v", {"p": (0.5, "cont")}).collect()[0].p is None


def test_refusals(gaps):
    days = gaps.sparkSession.sql("SELECT date'2024-01-05' AS d, 1 AS v")
    with pytest.raises(ValueError, match="no fixed number"):
        T.period_offset(days, [], "d", "day", "v", -1, "p", by="year")
    with pytest.raises(ValueError, match="right side"):
        J.join_range(days, days, "d", "d", "d", how="full")


def test_short_values_are_masked_whole(spark):
    df = spark.createDataFrame([("abc",), ("abcd",), ("abcde",), ("",), (None,)], "s string")
    assert [r.m for r in df.select(Y.mask_column(F.col("s"), "last4").alias("m")).collect()] == ["***", "****", "*bcde", "", None]
