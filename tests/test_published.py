"""Small fixtures with published expected rows: windows, levels of detail, ratios, business time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orrery.functions import aggregates as A, dates as D
from orrery.operators import filters as Q, lod as L, timeintel as T, windows as V


def day(i):
    return dt.date(2026, 6, i)


@pytest.fixture(scope="module")
def rolling(spark):
    rows = [(c, i, day(i), float(10 * i + (1000 if c == "Y" else 0)), float(i + (100 if c == "Y" else 0))) for c in "XY" for i in range(1, 13)]
    return spark.createDataFrame(rows, "cat string, day_index int, txn_date date, amount double, balance double")


@pytest.fixture(scope="module")
def gapped(spark):
    rows = []
    for c, days in (("X", range(1, 9)), ("Y", range(1, 9)), ("Z", (1, 2, 5, 8))):
        rows += [(c, day(i), float(10 * i + (1000 if c == "Y" else 0)), c != "Z" and i % 2 == 0) for i in days]
    return spark.createDataFrame(rows, "cat string, txn_date date, amount double, excluded boolean")


def series(df, cat, col="v"):
    return [r[col] for r in df.filter(F.col("cat") == cat).orderBy("txn_date").collect()]


def test_trailing_exclusive_is_the_default(rolling):
    v = series(rolling.withColumn("v", V.trailing_interval("sum", "amount", 3, "day", "txn_date", ["cat"])), "X")
    assert v[:3] == [None, 10.0, 30.0] and v[5] == 120.0


def test_trailing_inclusive(rolling):
    v = series(rolling.withColumn("v", V.trailing_interval("sum", "amount", 3, "day", "txn_date", ["cat"], inclusive=True)), "X")
    assert v[0] == 10.0 and v[5] == 150.0


def test_leading(rolling):
    v = series(rolling.withColumn("v", V.leading_interval("sum", "amount", 3, "day", "txn_date", ["cat"])), "X")
    assert v[5] == 240.0 and v[11] is None


def test_all_and_cumulative(rolling):
    out = rolling.withColumn("v", V.window_all("sum", "amount", ["cat"])).withColumn("c", V.cumulative("sum", "amount", ["txn_date"], ["cat"]))
    assert series(out, "X")[0] == 780.0 and series(out, "Y")[0] == 12780.0
    assert series(out, "X", "c")[5] == 210.0 and series(out, "Y", "c")[5] == 6210.0


def test_semi_additive_edges(rolling):
    last = {r.cat: r.v for r in T.last_value_semi(rolling, ["cat"], "txn_date", "balance", "v").collect()}
    first = {r.cat: r.v for r in T.first_value_semi(rolling, ["cat"], "txn_date", "balance", "v").collect()}
    assert last == {"X": 12.0, "Y": 112.0} and first == {"X": 1.0, "Y": 101.0}


def test_rows_and_dates_differ_on_gaps(gapped):
    z = gapped.withColumn("v", V.trailing_interval("sum", "amount", 3, "day", "txn_date", ["cat"])).withColumn(
        "r", V.moving("sum", "amount", 3, -1, ["txn_date"], ["cat"]))
    assert series(z, "Z") == [None, 10.0, 20.0, 50.0]
    assert series(z, "Z", "r") == [None, 10.0, 30.0, 80.0]


def test_filter_before_window(gapped):
    kept = gapped.filter(~F.col("excluded"))
    v = series(kept.withColumn("v", V.trailing_interval("sum", "amount", 3, "day", "txn_date", ["cat"])), "X")
    assert v == [None, 10.0, 30.0, 50.0]


def test_lod_sees_model_filters_but_not_query_filters(gapped):
    query_filter = {"excluded": ~F.col("excluded")}
    for rows, scope, x, y in (
        (gapped.filter(~F.col("excluded")), L.Scope(inherit=False), 160.0, 4160.0),
        (gapped, L.Scope(inherit=False), 360.0, 8360.0),
        (gapped, L.Scope(), 160.0, 4160.0),
    ):
        ctx = L.Context(rows, ("cat", "txn_date"), query_filter)
        out = ctx.lod(ctx.result({"n": F.count("*")}), "v", F.sum("amount"), L.Grouping(fixed=("cat",)), scope)
        got = {r.cat: r.v for r in out.collect()}
        assert (got["X"], got["Y"]) == (x, y)


def test_ratio_of_sums_at_every_grain(spark):
    df = spark.createDataFrame([("X", 1, 10.0, 1.0), ("X", 2, 10.0, 10.0), ("Y", 1, 100.0, 1.0), ("Y", 2, 100.0, 10.0)], "cat string, d int, revenue double, qty double")
    r = A.ratio_of_sums(F.col("revenue"), F.col("qty")).alias("v")
    assert sorted(x.v for x in df.groupBy("cat", "d").agg(r).collect()) == [1.0, 10.0, 10.0, 100.0]
    assert {x.cat: round(x.v, 3) for x in df.groupBy("cat").agg(r).collect()} == {"X": 1.818, "Y": 18.182}
    assert df.agg(r).first().v == 10.0


def test_period_offset_gives_null_before_the_first(spark):
    rows = [(c, dt.date(2026, m, 15), float(m * (1 if c == "X" else 100))) for c in "XY" for m in (5, 6, 7)]
    df = spark.createDataFrame(rows, "cat string, txn_date date, amount double")
    m = T.bucketed(df, ["cat"], "txn_date", "MONTHLY", {"amount": F.sum("amount")})
    out = T.period_offset(m, ["cat"], "period_start", "month", "amount", -1, "prior").filter("cat = 'X'").orderBy("period_start")
    assert [r.prior for r in out.collect()] == [None, 5.0, 6.0]


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def ts(s):
    return F.lit(s).cast("timestamp_ntz")


def test_business_time(spark):
    assert one(spark, D.business_days(ts("2026-01-05"), ts("2026-01-09"))) == 4
    assert one(spark, D.business_days(ts("2026-01-05"), ts("2026-01-09"), inclusive=True)) == 5
    assert one(spark, D.business_days(ts("2026-01-03"), ts("2026-01-11"))) == 4  # Saturday to Sunday: Monday to Friday
    assert one(spark, D.business_minutes(ts("2026-01-05 09:00:00"), ts("2026-01-06 09:00:00"))) == 1440
    assert one(spark, D.business_duration_str(ts("2026-01-05 09:00:00"), ts("2026-01-06 09:00:00"))) == "24:00"
    assert one(spark, D.business_minutes(ts("2026-01-09 12:00:00"), ts("2026-01-10 15:00:00"))) == 719  # Friday noon to its last minute


def test_durations(spark):
    assert one(spark, D.seconds_to_hms(F.lit(3665))) == "01:01:05"
    assert one(spark, D.seconds_to_dhms(F.lit(90061))) == "01:01:01:01"
    assert one(spark, D.minutes_to_hm(F.lit(65))) == "01:05"
    assert one(spark, D.minutes_to_dhm(F.lit(1501))) == "01:01:01"
    assert one(spark, D.seconds_to_hms(F.lit(360000))) == "100:00:00"  # wide hours are not cut


def test_boundary_counts(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, D.diff_months(d("2024-02-01"), d("2024-01-31"))) == 1
    assert one(spark, D.diff_weeks(d("2024-01-08"), d("2024-01-07"))) == 1  # Sunday to Monday
    assert one(spark, D.diff_years(d("2024-01-01"), d("2023-12-31"))) == 1
    assert one(spark, D.diff_days(d("2024-01-01"), d("2024-01-05"))) == -4


def test_fiscal(spark):
    d = F.lit("2013-05-20").cast("date")
    assert one(spark, D.year_name(d, 4)) == "FY_2014"
    assert one(spark, D.start_of_year(d, 4)) == dt.date(2013, 4, 1)
    assert one(spark, D.quarter_number(d, 4)) == 1


def test_parameter_is_checked():
    p = Q.Parameter("p", "INT64", 5, allowed=[5, 10])
    with pytest.raises(ValueError):
        p.value(7)
    with pytest.raises(ValueError):
        Q.Parameter("p", "DOUBLE", 0.0, low=0.0, high=1.0).value(2.0)
