import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from orrery import catalogue as C
from orrery.operators import levels as V, lod as L
from orrery.operators.rollups import Measure

ROWS = [
    ("a", "x", 1, 10.0, "O"), ("a", "x", 2, 20.0, "F"), ("a", "y", 1, 30.0, "O"), ("a", "y", 3, None, "O"), ("b", "x", 2, 5.0, "F"),
    (None, "x", 4, 7.0, "O"), (None, None, None, 8.0, "O"), ("c", "z", 5, 9.0, None), ("b", "z", 2, 5.0, "O"), ("b", "z", 2, 5.0, "O"),
]
KINDS = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "AVG": F.avg, "UNIQUE_COUNT": F.count_distinct}
SCOPES = [
    lambda: L.Scope(), lambda: L.Scope(inherit=False), lambda: L.Scope(minus=("status",)), lambda: L.Scope(plus={"v": F.col("v") > 9}),
    lambda: L.Scope(inherit=False, plus={"status": F.col("status") == "none"}),
]
GROUPINGS = [L.Grouping(), L.Grouping(fixed=("g",)), L.Grouping(fixed=()), L.Grouping(minus=("g",)), L.Grouping(only=("h", "status"))]


@pytest.fixture(scope="module")
def ctx(spark):
    df = spark.createDataFrame(ROWS, "g string, h string, k int, v double, status string")
    return L.Context(df, ("g", "h"), {"status": F.col("status") == "O", "k": F.col("k") < 5})


@pytest.mark.parametrize("grouping", GROUPINGS, ids=str)
def test_values_agree_with_separate_queries(ctx, grouping):
    """Each kind under each scope, all in one pass, against one filter and grouping a value."""
    values = [V.Value(Measure(f"{kind}_{i}", kind, "v"), grouping, s()) for kind in KINDS for i, s in enumerate(SCOPES)]
    got = V.beside(ctx, [V.Value(Measure("main", "SUM", "v")), *values])
    want = ctx.result({"main": F.sum("v")})
    for v in values:
        want = ctx.lod(want, v.name, KINDS[v.measure.kind]("v"), grouping, v.scope)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_finer_values_are_aggregated_again(ctx):
    fine = V.Value(Measure("most", "COUNT", "v"), L.Grouping(plus=("k",)), L.Scope(inherit=False), again=F.max)
    got = V.beside(ctx, [V.Value(Measure("main", "SUM", "v")), fine])
    want = ctx.lod(ctx.result({"main": F.sum("v")}), "most", F.count("v"), L.Grouping(plus=("k",)), L.Scope(inherit=False), again=F.max)
    assert rows(got) == rows(want)
    with pytest.raises(ValueError, match="again"):
        V.beside(ctx, [V.Value(Measure("n", "SUM", "v"), L.Grouping(plus=("k",)))])


def test_no_rows_and_no_dimensions(ctx, spark):
    none = L.Context(ctx.rows.limit(0), ("g",), ctx.filters)
    values = [V.Value(Measure("n", "COUNT", "v")), V.Value(Measure("u", "UNIQUE_COUNT", "v"))]
    assert V.beside(none, values).count() == 0
    assert rows(V.beside(L.Context(ctx.rows, (), ctx.filters), values)) == [(5, 4)]


def scanned(spark, name):
    plan = C.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan")


def test_every_table_is_scanned_once(spark):
    for name in ("set_override", "lod_add_filter", "lod_unique_count"):
        # Coarser values come from grouped rows that are written while the question is built.
        assert scanned(spark, name) == (4 if name == "set_override" else 0)
