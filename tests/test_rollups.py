"""Rollups answer as the base does; advice agrees with brute force; sketches keep their error bound."""

import datetime as dt
import itertools

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import orrery.catalogue as C
from conftest import SMALL
from orrery.catalogue import rollups as Q
from orrery.operators import advice as A, rollups as P
from orrery.operators.joins import semi_join


def test_regroups():
    assert P.regroups("DAILY", "MONTHLY") and P.regroups("MONTHLY", "MONTHLY") and P.regroups(None, "HOURLY")
    assert not P.regroups("MONTHLY", "DAILY") and not P.regroups("MONTHLY", None)
    assert not P.regroups("WEEKLY", "MONTHLY") and P.regroups("WEEKLY", "WEEKLY")


def test_decompose():
    assert [c.again for c in P.stored(P.Measure("n", "COUNT", "x")).components] == ["SUM"]
    assert [c.func for c in P.stored(P.Measure("a", "AVG", "x")).components] == ["SUM", "COUNT"]
    u = P.stored(P.Measure("u", "UNIQUE_COUNT", "cust"))
    assert not u.decomposable and u.requires == "cust"
    assert P.stored(P.Measure("b", "LAST_VALUE", "x", over="d")).requires == "d"


def test_unique_count_needs_its_column(t):
    with pytest.raises(ValueError, match="lacks"):
        P.build_rollup(t.orders, ["o_orderstatus"], {}, [P.Measure("buyers", "UNIQUE_COUNT", "o_custkey")])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 900), st.integers(-50, 50), st.integers(0, 9)), min_size=1, max_size=60), st.sampled_from(["MONTHLY", "QUARTERLY", "YEARLY"]))
def test_rollup_answers_as_the_base(spark, data, bucket):
    df = spark.createDataFrame([(g, dt.date(2023, 1, 1) + dt.timedelta(days=d), float(x), float(w)) for g, d, x, w in data], "g string, d date, x double, w double")
    m = [P.Measure("s", "SUM", "x"), P.Measure("n", "COUNT", "x"), P.Measure("lo", "MIN", "x"), P.Measure("hi", "MAX", "x"), P.Measure("avg", "AVG", "x"),
         P.Measure("r", "RATIO", "x", per="w"), P.Measure("rs", "RATIO", "x", per="w", safe=True)]
    roll = P.build_rollup(df, ["g"], {"d": "DAILY"}, m)
    a = sorted(tuple(r) for r in P.reaggregate(roll, ["g"], {"d": bucket}, m).fillna(-1e9).collect())
    b = sorted(tuple(r) for r in P.direct(df, ["g"], {"d": bucket}, m).fillna(-1e9).collect())
    assert [x[:2] for x in a] == [x[:2] for x in b]
    for x, y in zip(a, b):
        assert list(x[2:]) == pytest.approx(list(y[2:]))


def test_answer_takes_the_smallest_cover(t):
    df = t.orders.withColumn("day", F.to_date("o_orderdate"))
    m = (P.Measure("total", "SUM", "o_totalprice"),)
    wrong = df.limit(0)  # would answer with nothing, so the choice shows
    small = P.Rollup("small", wrong, ("o_orderstatus",), {"day": "YEARLY"}, ("total",), 3)
    big = P.Rollup("big", P.build_rollup(df, ["o_orderstatus", "o_orderpriority"], {"day": "MONTHLY"}, m), ("o_orderstatus", "o_orderpriority"), {"day": "MONTHLY"}, ("total",), 500)
    q = P.Request(("o_orderstatus",), {"day": "QUARTERLY"}, m)
    assert P.lacks(small, q) and not P.lacks(big, q)
    assert P.answer(q, [small, big], df).count() == P.direct(df, ["o_orderstatus"], {"day": "QUARTERLY"}, m).count()
    assert not P.lacks(small, P.Request(("o_orderstatus",), {"day": "YEARLY"}, m))
    assert P.lacks(big, P.Request((), {}, m, {"o_custkey": F.col("o_custkey") == 1}))


def test_parity_sees_a_lost_row(t):
    m = [P.Measure("n", "COUNT", "o_orderkey")]
    roll = P.build_rollup(t.orders.filter("o_orderkey <> 5"), ["o_orderstatus"], {}, m)
    assert P.rollup_parity(roll, t.orders, ["o_orderstatus"], m).filter("NOT agrees").count() == 1


def test_sketches_keep_their_error(spark, t):
    got = {r.r_name: r.orders for r in C.QUERIES["distinct_sketch_component"](spark, SMALL).collect()}
    want = {r.r_name: r.n for r in Q.rows(t).groupBy("r_name").agg(F.count_distinct("l_orderkey").alias("n")).collect()}
    assert all(abs(got[k] - n) <= 0.05 * n + 2 for k, n in want.items()) and got.keys() == want.keys()
    got = {r.l_returnflag: r.orders for r in C.QUERIES["agg_approx_distinct"](spark, SMALL).collect()}
    want = {r.l_returnflag: r.n for r in t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("n")).collect()}
    assert all(abs(got[k] - n) <= 0.08 * n for k, n in want.items())
    near = {r.l_returnflag: (r.lines, r.within) for r in C.QUERIES["agg_percentile_approx"](spark, SMALL).collect()}
    lines = {r.l_returnflag: r["count"] for r in t.lineitem.groupBy("l_returnflag").count().collect()}
    assert near == {flag: (n, True) for flag, n in lines.items()}
    for r in t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.9, 10_000).alias("p")).collect():
        share = t.lineitem.filter(F.col("l_returnflag") == r.l_returnflag).agg(F.avg((F.col("l_extendedprice") <= r.p).cast("int"))).first()[0]
        assert abs(share - 0.9) < 0.01
    sketch = {r.grain: (r.agg_rows, r.within) for r in C.QUERIES["profile_grains_sketch"](spark, SMALL).collect()}
    exact = {r.grain: r.agg_rows for r in C.QUERIES["profile_grains"](spark, SMALL).collect()}
    assert sketch == {k: (n, True) for k, n in exact.items()}
    sketch = {r.column_name: (r.distinct_values, r.within) for r in C.QUERIES["audit_cardinality_sketch"](spark, SMALL).collect()}
    for c in ("o_orderkey", "o_orderstatus", "o_totalprice"):
        assert sketch[c] == (t.orders.agg(F.count_distinct(c)).first()[0], True)


def brute_greedy(shapes, cands, served, base):
    """Straight from the definition: rows saved times weight against the best so far."""
    chosen, best, out = [], {}, []
    while len(chosen) < 10:
        gains = {c: sum(shapes[s] * max(0, best.get(s, base) - rows) for s in served[c]) for c, rows in cands.items() if c not in chosen}
        if not gains:
            break
        pick = sorted(gains, key=lambda c: (-gains[c], c))[0]
        if gains[pick] <= 0:
            break
        chosen.append(pick)
        for s in served[pick]:
            best[s] = min(best.get(s, base), cands[pick])
        out.append((pick, gains[pick], round(100 * sum(shapes[s] for s in best) / sum(shapes.values()), 1)))
    return out


def test_greedy_choice_and_coverage(spark, t):
    shapes, cands = Q.shapes(t), Q.candidates(t)
    sr = {r.shape_id: r for r in shapes.collect()}
    cr = {r.rollup_id: r for r in cands.collect()}
    level = {"MONTHLY": 3, "QUARTERLY": 4}
    want = {c: set() for c in cr}
    for (cid, c), (sid, s) in itertools.product(cr.items(), sr.items()):
        ok = set(s.dimensions) <= set(c.dimensions) and set(s.filter_columns) <= set(c.dimensions) and "buyers" not in s.measures
        if s.date_column:
            ok = ok and c.date_column == s.date_column and level[c.bucket] <= level[s.bucket]
        if ok:
            want[cid].add(sid)
    got = {c: set() for c in cr}
    for r in A.coverage(shapes, cands, Q.PLANS).collect():
        got[r.rollup_id].add(r.shape_id)
    assert got == want
    base = t.lineitem.count()
    curve = [(r.rollup_id, r.benefit, r.coverage_pct) for r in A.choose_rollups(shapes, cands, Q.PLANS).orderBy("step").collect()]
    assert curve == brute_greedy({s: r.weight for s, r in sr.items()}, {c: r.agg_rows for c, r in cr.items()}, want, base)


def shape(spark, rows):
    return spark.createDataFrame(rows, "shape_id string, dimensions array<string>, date_column string, bucket string, measures array<string>, filter_columns array<string>, weight double")


def test_candidates_merge_only_similar_sets(spark):
    s = shape(spark, [("1", ["a", "b"], None, None, ["revenue"], [], 1.0), ("2", ["b", "c"], None, None, ["revenue"], [], 1.0), ("3", ["a", "b", "c"], "d", "WEEKLY", ["revenue"], [], 1.0),
                      ("4", ["a", "b", "c"], "d", "MONTHLY", ["revenue"], ["d"], 1.0), ("5", ["a", "b"], "d", None, ["revenue"], ["x"], 1.0)])
    got = {r.rollup_id: (r.bucket, r.covered) for r in A.candidate_grains(s, Q.PLANS).collect()}
    # {a,b} and {b,c} share one of three columns: not similar. Weeks and months together need days.
    assert "a+b+c|-" not in got
    assert got["a+b+c|d"] == ("DAILY", 4)
    assert got["a+b|-"] == (None, 1)
    assert got["a+b+x|d"][0] is None  # a question about single dates needs the raw date
    assert got["a+b+c+x|d"][1] == 5


def test_distinct_measure_needs_its_column(spark):
    s = shape(spark, [("1", ["a"], None, None, ["buyers"], [], 1.0), ("2", ["a"], None, None, ["unknown"], [], 1.0)])
    cands = spark.createDataFrame([("p", ["a"], None, None, 5), ("q", ["a", "customer"], None, None, 50)], "rollup_id string, dimensions array<string>, date_column string, bucket string, agg_rows bigint")
    assert [(r.rollup_id, r.shape_id) for r in A.coverage(s, cands, Q.PLANS).collect()] == [("q", "1")]


def test_log_parser(spark):
    texts = ['SELECT a FROM t GROUP BY "T"."A", b ORDER BY 1', "select 1 from t group by date_trunc('MONTH', d), t.a;", "select 1", "SELECT x FROM t GROUP\n BY T.X HAVING count(*) > 1"]
    cols, dropped = A.grouped_names(F.col("q"))
    got = [(r.c, r.d) for r in spark.createDataFrame([(x,) for x in texts], "q string").select(cols.alias("c"), dropped.alias("d")).collect()]
    assert got == [(["T.A", "B"], False), (["T.A"], True), ([], False), (["T.X"], False)]


def test_semi_join_never_raises_a_sum(spark, t):
    many = t.lineitem.select("l_orderkey")  # keys repeat
    kept = semi_join(t.orders, many, [("o_orderkey", "l_orderkey")])
    assert kept.count() <= t.orders.count() and kept.groupBy("o_orderkey").count().filter("count > 1").count() == 0


def test_dates_are_covered_one_by_one(spark):
    """A grain serves a shape of two dates if it holds both, each by a bucket that makes the one asked for."""
    made = lambda i, dates, filters=(): (i, ["a"], dates, ["m"], list(filters), 1.0)
    shapes = spark.createDataFrame([
        made("none", []), made("x", [("x", "MONTHLY")]), made("both", [("x", "MONTHLY"), ("y", "YEARLY")]), made("raw", [("x", None), ("y", "YEARLY")]),
        made("weeks", [("x", "WEEKLY"), ("y", "WEEKLY")]), made("filter", [("x", "MONTHLY")], ["x", "a"]), made("other", [("x", "MONTHLY")], ["y"]),
    ], f"shape_id string, dimensions array<string>, dates {A.DATES}, measures array<string>, filter_columns array<string>, weight double")
    cands = spark.createDataFrame([
        ("x", ["a"], [("x", "DAILY")]), ("xy", ["a"], [("y", "MONTHLY"), ("x", "MONTHLY")]), ("raw", ["a"], [("x", None), ("y", None)]), ("week", ["a"], [("x", "WEEKLY"), ("y", "DAILY")]),
    ], f"rollup_id string, dimensions array<string>, dates {A.DATES}")
    plans = [P.stored(P.Measure("m", "SUM", "v"))]
    got = {}
    for r in A.coverage(shapes, cands, plans).collect():
        got.setdefault(r.rollup_id, set()).add(r.shape_id)
    assert got == {
        "x": {"none", "x", "filter"}, "xy": {"none", "x", "both", "filter"},
        "raw": {"none", "x", "both", "raw", "weeks", "filter"}, "week": {"none", "weeks"},
    }
    grains = {r.rollup_id: [(d.column, d.bucket) for d in r.dates] for r in A.candidate_grains(shapes, plans).collect()}
    # Weeks beside years make the second date daily; the raw date makes the first one raw.
    assert grains["a|x+y"] == [("x", None), ("y", "DAILY")]
    assert grains["a|x"] == [("x", "MONTHLY")] and grains["a|-"] == []


def test_lattice_against_separate_counts(spark, t):
    df = t.lineitem.withColumn("l_tax", F.when(F.col("l_tax") > 0.04, F.col("l_tax")))
    month = F.trunc("l_shipdate", "month")
    grains = {"flag": ["l_returnflag"], "both": ["l_returnflag", "l_linestatus"], "month": ["l_returnflag", month], "tax": ["l_tax"], "again": ["l_linestatus", "l_returnflag"],
              "wide": ["l_returnflag", "l_linestatus", "l_tax", month]}
    got = {r.grain: (r.agg_rows, r.base_rows) for r in P.grain_lattice(df, grains).collect()}
    assert got == {n: (df.select(*g).distinct().count(), df.count()) for n, g in grains.items()}
    assert {r.grain: (r.agg_rows, r.base_rows) for r in P.grain_lattice(df.limit(0), {"flag": ["l_returnflag"]}).collect()} == {"flag": (0, 0)}
    plan = P.grain_lattice(df, grains)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "FileScan" not in plan
