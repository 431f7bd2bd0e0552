"""Edges of operators that the large comparisons do not reach."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from orrery.functions import dates as D, numbers as N, passthrough as P, text as X
from orrery.operators import audit as A, joins as J, lod as L, sets as S


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return r[0] if len(cols) == 1 else tuple(r)


def test_text_edges(spark):
    s = F.lit("a-b-c")
    assert one(spark, X.find_nth(s, "-", 2), X.find_nth(s, "-", 3), X.find_nth(F.lit(None).cast("string"), "-", 1)) == (4, 0, None)
    assert one(spark, X.text_between(F.lit("x[1][2]"), "[", "]", 2), X.text_between(F.lit("x[1"), "[", "]")) == ("2", None)
    assert one(spark, X.keep_chars(F.lit("a]b-c^1"), "]-^"), X.purge_chars(F.lit("a]b"), "]")) == ("]-^", "ab")
    assert one(spark, X.wild_match(F.lit("50%_x"), "50%_*"), X.wild_match(F.lit("50ab"), "50%_*"), X.wild_match(F.lit("cat"), "c?t")) == (True, False, True)
    assert one(spark, X.concat(F.lit("a"), F.lit(None)), X.substr(F.lit("abc"), 0, 2)) == (None, "ab")


def test_number_edges(spark):
    assert one(spark, N.safe_divide(F.lit(1), F.lit(0)), N.safe_divide(F.lit(1), F.lit(None)), N.ratio(F.lit(1), F.lit(0))) == (0.0, 0.0, None)
    assert one(spark, N.trunc(F.lit(-1.57), 1), N.to_int(F.lit(-1.9)), N.mod(F.lit(-7), F.lit(3))) == (-1.5, -1, -1)
    assert one(spark, N.to_integer(F.lit("2.5")), N.to_integer(F.lit("x")), N.to_bool(F.lit("maybe"))) == (3, None, None)
    assert one(spark, N.range_avg(F.lit(None).cast("int"), F.lit(None).cast("int")), N.range_sum(F.lit(None).cast("int"))) == (None, 0.0)
    assert one(spark, N.combination(F.lit(5), F.lit(2)), N.combination(F.lit(2), F.lit(5)), N.permutation(F.lit(5), F.lit(2))) == (10.0, 0.0, 20.0)
    assert one(spark, F.round(N.sin_deg(F.lit(30.0)), 9), F.round(N.asin_deg(F.lit(0.5)), 9)) == (0.5, 30.0)
    assert one(spark, N.future_value(F.lit(0.0), F.lit(10), F.lit(-5.0))) == 50.0


def test_labels(spark):
    lab = lambda s: D.parse_fiscal_label(F.lit(s))
    got = one(spark, lab("FY2016"), lab("_2016_17"), lab("2016-03"), lab("2016"), lab("2016-13"), lab("x2016"))
    assert [str(g) for g in got] == ["2016-01-01", "2016-01-01", "2016-03-01", "2016-01-01", "None", "None"]


def test_template_placeholders(spark):
    with pytest.raises(ValueError):
        P.sql_scalar_op("int", "{0} + {2}", "a", "b")
    df = spark.createDataFrame([(3,)], "`odd name` int")
    assert df.select(P.sql_scalar_op("int", "{0} * 2", "odd name").alias("v")).first().v == 6


def test_null_members(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "m string")
    pick = lambda *m, **k: [r.m for r in df.filter(S.set_static(F.col("m"), list(m), **k)).collect()]
    assert pick("a", None) == ["a", None] and pick("a", exclude=True) == ["b", None] and pick(None, exclude=True) == ["a", "b"]


def test_top_members_keep_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 4), ("d", 1)], "m string, v int")
    assert rows(S.ranked_members(df, "m", F.sum("v"), 2)) == [("a",), ("b",), ("c",)]
    assert rows(S.ranked_members(df, "m", F.sum("v"), 1, top=False)) == [("d",)]
    assert rows(S.topn_with_others(df, "m", "v", 1)) == [("Others", True, 9), ("a", False, 5)]


def test_pass_through_filters(spark):
    df = spark.createDataFrame([("a", "x", 9), ("b", "y", 5), ("c", "y", 1)], "m string, k string, v int")
    f = {"k": F.col("k") == "y"}
    top = lambda **kw: rows(S.set_query(df, "m", F.sum("v"), 1, f, **kw))
    assert top() == [("a",)] and top(accept_all=True) == [("b",)] and top(include=["k"]) == [("b",)] and top(exclude=["k"]) == [("a",)]


def test_union_typed_refuses(spark):
    with pytest.raises(ValueError):
        S.union_typed(spark.range(1), spark.range(1).select(F.col("id").cast("string")))
    with pytest.raises(ValueError):
        S.union_typed(spark.range(1), spark.range(1).select("id", "id"))


def test_drill_across_matches_null_dims(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "d string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "d string, b int")
    assert rows(J.drill_across([a, b], ["d"])) == [(None, 2, 3), ("x", 1, None), ("y", None, 4)]
    with pytest.raises(ValueError):
        J.drill_across([a, a], ["d"])


def test_scalar_row_must_be_one(spark):
    with pytest.raises(Exception, match="(?i)more than one row"):
        J.cross_scalar(spark.range(2), spark.range(3).withColumnRenamed("id", "x")).collect()


def test_fixed_level_is_constant_in_its_partition(t):
    out = L.group_value(t.part, ["p_brand"], F.sum("p_retailprice"), "v")
    assert out.count() == t.part.count()
    assert out.groupBy("p_brand").agg(F.count_distinct("v").alias("n")).filter("n <> 1").count() == 0


def test_finer_level_needs_a_second_aggregate(t):
    ctx = L.Context(t.orders, ("o_orderstatus",))
    with pytest.raises(ValueError, match="finer"):
        ctx.lod(ctx.result({"n": F.count("*")}), "v", F.sum("o_totalprice"), L.Grouping(plus=("o_custkey",)))


def test_name_categories():
    hit = {n: A.name_category(n) for n in ("e_mail", "cell_phone", "ssn", "birth_date", "iban", "last_name", "zip_code", "amount")}
    assert [v and v[0] for v in hit.values()] == ["email", "phone", "national_id", "dob", "financial", "person_name", "address", None]


def test_value_patterns(spark):
    texts = {"email": "write to a.b@c-d.org now", "phone": "call (555) 123-4567", "national_id": "no 123-45-6789.", "dob": "Born on 1990-05-01", "financial": "4111 1111 1111 1111", "person_name": "First name: Al", "address": "zip code: 90210"}
    df = spark.createDataFrame([(x,) for x in texts.values()], "text string")
    got = {r.category: r.rows for r in A.pii_values(df, ["text"]).collect()}
    assert all(got[k] >= 1 for k in texts), got


def test_duplicate_tables_ignore_order(spark):
    a = spark.range(100)
    got = rows(A.duplicates({"a": a, "b": a.orderBy(F.desc("id")), "c": spark.range(99)}))
    assert got == [("a, b", 100)]


def test_plans_have_no_cross_joins(spark, t):
    """Joins are on keys; only range joins add a bin to have one."""
    import orrery.catalogue as C
    from conftest import SMALL

    for name in ("join_range", "join_asof", "join_date_period", "lod_grand_total", "percent_of_total", "rank", "model_two_facts", "candidate_grains", "point_in_time_count", "network_days"):
        p = C.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in p and "NestedLoop" not in p, name
