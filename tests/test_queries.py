"""Every named query agrees with its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_points
import check
from orrery import catalogue
from conftest import SMALL

QUERIES, SQLS = catalogue.QUERIES, catalogue.ORACLES


@pytest.fixture(scope="module")
def con():
    return check.oracle(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    message, _, good = check.compare(spark, con, name, QUERIES[name], SQLS.get(name), SMALL)
    assert good or message == "EMPTY", message


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(QUERIES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["r_name", "order_year", "revenue", "lines"] and df.count() > 0


def test_check_sees_a_difference(spark, con):
    """The comparison itself must be able to fail."""
    fn = QUERIES["agg_sum"]
    wrong = SQLS["agg_sum"].replace("sum(l_extendedprice)", "sum(l_extendedprice) + 0.01")
    assert not check.compare(spark, con, "agg_sum", fn, wrong, SMALL)[2]
    assert not check.compare(spark, con, "agg_sum", fn, SQLS["agg_sum"].replace("AS v", "AS w"), SMALL)[2]
    assert not check.compare(spark, con, "agg_sum", fn, SQLS["agg_sum"] + " LIMIT 2", SMALL)[2]
