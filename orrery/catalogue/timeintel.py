"""Semi-additive measures and time intelligence; daily order totals play the snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalogue.registry import query
from orrery.functions import dates as D
from orrery.operators import timeintel as T

c = F.col
R = F.round
REF = "2000-06-15"
ref = lambda: F.lit(REF).cast("date")
r2 = lambda df, *names: df.withColumns({n: R(n, 2) for n in names})


def balances(t):
    """Balances per customer segment, nation and day, taken from the order totals of that day."""
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select(
        "c_mktsegment", c("c_nationkey").cast("bigint").alias("c_nationkey"), "o_custkey",
        F.to_date("o_orderdate").alias("day"), c("o_totalprice").alias("balance"))


BAL = "b AS (SELECT c_mktsegment, c_nationkey::BIGINT AS c_nationkey, o_custkey, o_orderdate::DATE AS day, o_totalprice AS balance FROM orders JOIN customer ON o_custkey = c_custkey)"


def edge_sql(groups: str, pick: str = "max") -> str:
    on = " AND ".join(f"b.{g} = e.{g}" for g in groups.split(", "))
    return f"""SELECT {', '.join('b.' + g for g in groups.split(', '))}, round(sum(balance), 2) AS v FROM b
        JOIN (SELECT {groups}, {pick}(day) AS d FROM b GROUP BY {groups}) e ON {on} AND b.day = e.d GROUP BY ALL"""


@query("last_value_semi", f"WITH {BAL} {edge_sql('c_mktsegment, c_nationkey')}")
def last_value_semi(t):
    return r2(T.last_value_semi(balances(t), ["c_mktsegment", "c_nationkey"], "day", "balance", "v"), "v")


@query("first_value_semi", f"WITH {BAL} {edge_sql('c_mktsegment', 'min')}")
def first_value_semi(t):
    return r2(T.first_value_semi(balances(t), ["c_mktsegment"], "day", "balance", "v"), "v")


_RES = "q AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM b GROUP BY 1, 2)"
res = lambda t: balances(t).groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("semi_grouping_fixed", f"WITH {BAL}, {_RES} SELECT q.*, e.v FROM q JOIN ({edge_sql('c_nationkey')}) e ON q.c_nationkey = e.c_nationkey")
def semi_grouping_fixed(t):
    return r2(T.semi_beside(res(t), balances(t), ["c_nationkey"], "day", "balance", "v"), "v")


@query("semi_grouping_total", f"WITH {BAL}, {_RES} SELECT q.*, (SELECT round(sum(balance), 2) FROM b WHERE day = (SELECT max(day) FROM b)) AS v FROM q")
def semi_grouping_total(t):
    return r2(T.semi_beside(res(t), balances(t), [], "day", "balance", "v"), "v")


@query("semi_grouping_minus", f"WITH {BAL}, {_RES} SELECT q.*, e.v FROM q JOIN ({edge_sql('c_mktsegment')}) e ON q.c_mktsegment = e.c_mktsegment")
def semi_grouping_minus(t):
    dims = [d for d in ["c_mktsegment", "c_nationkey"] if d != "c_nationkey"]
    return r2(T.semi_beside(res(t), balances(t), dims, "day", "balance", "v"), "v")


@query("last_value_in_period", f"WITH {BAL} SELECT c_mktsegment, date_trunc('month', day)::DATE AS period_start, round(sum(balance) FILTER (day = last_day(day)), 2) AS v FROM b GROUP BY 1, 2")
def last_value_in_period(t):
    return r2(T.edge_value_in_period(balances(t), ["c_mktsegment"], "day", "month", "balance", "v"), "v")


@query("first_value_in_period", f"WITH {BAL} SELECT c_mktsegment, date_trunc('quarter', day)::DATE AS period_start, round(sum(balance) FILTER (day = date_trunc('quarter', day)), 2) AS v FROM b GROUP BY 1, 2")
def first_value_in_period(t):
    return r2(T.edge_value_in_period(balances(t), ["c_mktsegment"], "day", "quarter", "balance", "v", last=False), "v")


@query("semi_reaggregate", f"WITH {BAL} SELECT c_mktsegment, max(v) AS v FROM ({edge_sql('c_mktsegment, c_nationkey')}) GROUP BY 1")
def semi_reaggregate(t):
    return r2(T.semi_reaggregate(balances(t), ["c_mktsegment", "c_nationkey"], "day", "balance", ["c_mktsegment"], F.max, "v"), "v")


_SNAP = """(SELECT s.c_nationkey, s.period_start, round(sum(balance), 2) AS v FROM (SELECT *, date_trunc('month', day)::DATE AS period_start FROM b) s
    JOIN (SELECT c_nationkey, date_trunc('month', day)::DATE AS p, max(day) AS d FROM b GROUP BY 1, 2) e ON s.c_nationkey = e.c_nationkey AND s.day = e.d GROUP BY 1, 2)"""


@query("snapshot_period_end", f"WITH {BAL} SELECT * FROM {_SNAP}")
def snapshot_period_end(t):
    return r2(T.snapshot_period_end(balances(t), ["c_nationkey"], "day", "MONTHLY", "balance", "v"), "v")


# --- periods ----------------------------------------------------------------------------------
def weekly_thin(t):
    """Order totals of each nation by month, without the months that have few orders: there are gaps."""
    return r2(T.bucketed(balances(t), ["c_nationkey"], "day", "MONTHLY", {"total": F.sum("balance"), "n": F.count("*")}).filter("n > 7").drop("n"), "total")


_THIN = "g AS (SELECT c_nationkey, date_trunc('month', day)::DATE AS period_start, round(sum(balance), 2) AS total FROM b GROUP BY 1, 2 HAVING count(*) > 7)"


def offset(name: str, unit: str, n: int, by: str | None, months: int) -> None:
    query(name, f"WITH {BAL}, {_THIN} SELECT g.*, p.total AS prior FROM g LEFT JOIN g p ON p.c_nationkey = g.c_nationkey AND p.period_start = (g.period_start - INTERVAL {months} MONTH)::DATE")(
        lambda t: T.period_offset(weekly_thin(t), ["c_nationkey"], "period_start", unit, "total", n, "prior", by))


offset("period_offset", "month", -1, None, 1)
offset("past_month", "month", -1, "month", 1)
offset("past_quarter", "month", -1, "quarter", 3)
offset("past_year", "month", -1, "year", 12)

DAILY = "d AS (SELECT c_mktsegment, day, round(sum(balance), 2) AS total FROM b GROUP BY 1, 2)"
daily = lambda t: r2(balances(t).groupBy("c_mktsegment", "day").agg(F.sum("balance").alias("total")), "total")


@query("past_day", f"WITH {BAL}, {DAILY} SELECT d.*, p.total AS prior FROM d LEFT JOIN d p ON p.c_mktsegment = d.c_mktsegment AND p.day = d.day - 1")
def past_day(t):
    return T.period_offset(daily(t), ["c_mktsegment"], "day", "day", "total", -1, "prior")


@query("past_week", "WITH w AS (SELECT o_orderstatus, date_trunc('week', o_orderdate)::DATE AS period_start, count(*) AS n FROM orders GROUP BY 1, 2) SELECT w.*, p.n AS prior FROM w LEFT JOIN w p ON p.o_orderstatus = w.o_orderstatus AND p.period_start = w.period_start - 7")
def past_week(t):
    w = T.bucketed(t.orders, ["o_orderstatus"], "o_orderdate", "WEEKLY", {"n": F.count("*")})
    return T.period_offset(w, ["o_orderstatus"], "period_start", "week", "n", -1, "prior")


for _name, _cols in (("growth", ["growth"]), ("growth_rate", ["growth_rate"]), ("diff_past_month", ["difference"])):
    _sqls = {"growth": "round((g.total - p.total) / p.total, 8)", "growth_rate": "round(g.total / p.total, 8)", "difference": "round(g.total - p.total, 2)"}
    query(_name, f"WITH {BAL}, {_THIN} SELECT g.c_nationkey, g.period_start, {_sqls[_cols[0]]} AS v FROM g LEFT JOIN g p ON p.c_nationkey = g.c_nationkey AND p.period_start = (g.period_start - INTERVAL 1 MONTH)::DATE")(
        lambda t, k=_cols[0]: T.growth(T.period_offset(weekly_thin(t), ["c_nationkey"], "period_start", "month", "total", -1, "prior"), "total", "prior").select(
            "c_nationkey", "period_start", R(k, 2 if k == "difference" else 8).alias("v")))

for _name, _by, _months in (("diff_past_quarter", "quarter", 3), ("diff_past_year", "year", 12)):
    query(_name, f"WITH {BAL}, {_THIN} SELECT g.c_nationkey, g.period_start, round(g.total - p.total, 2) AS difference FROM g LEFT JOIN g p ON p.c_nationkey = g.c_nationkey AND p.period_start = (g.period_start - INTERVAL {_months} MONTH)::DATE")(
        lambda t, by=_by: r2(T.growth(T.period_offset(weekly_thin(t), ["c_nationkey"], "period_start", "month", "total", -1, "prior", by), "total", "prior"), "difference").select(
            "c_nationkey", "period_start", "difference"))
for _name, _unit, _days in (("diff_past_day", "day", 1), ("diff_past_week", "week", 7)):
    query(_name, f"WITH g AS (SELECT o_orderstatus, date_trunc('{_unit}', o_orderdate)::DATE AS period_start, count(*) AS n FROM orders GROUP BY 1, 2) SELECT g.*, g.n - p.n AS difference FROM g LEFT JOIN g p ON p.o_orderstatus = g.o_orderstatus AND p.period_start = g.period_start - {_days}")(
        lambda t, u=_unit: T.growth(T.period_offset(
            T.bucketed(t.orders, ["o_orderstatus"], "o_orderdate", "DAILY" if u == "day" else "WEEKLY", {"n": F.count("*")}),
            ["o_orderstatus"], "period_start", u, "n", -1, "prior"), "n", "prior").select("o_orderstatus", "period_start", "n", "difference"))

_Y = "sum(o_totalprice) FILTER (year(o_orderdate) = {y})"


@query("sply", f"SELECT o_orderpriority, round({_Y.format(y=2000)}, 2) AS this_year, round({_Y.format(y=1999)}, 2) AS prior_year FROM orders GROUP BY 1")
def sply(t):
    return r2(t.orders.groupBy("o_orderpriority").agg(*[m.alias(n) for n, m in T.reference_years("o_orderdate", "o_totalprice", ref()).items() if "yoy" not in n]), "this_year", "prior_year")


@query("yoy", f"SELECT o_orderpriority, round({_Y.format(y=2000)} - {_Y.format(y=1999)}, 2) AS yoy FROM orders GROUP BY 1")
def yoy(t):
    return r2(t.orders.groupBy("o_orderpriority").agg(T.reference_years("o_orderdate", "o_totalprice", ref())["yoy"].alias("yoy")), "yoy")


@query("yoy_pct", f"SELECT o_orderpriority, round(({_Y.format(y=2000)} - {_Y.format(y=1999)}) / {_Y.format(y=1999)}, 8) AS yoy_pct FROM orders GROUP BY 1")
def yoy_pct(t):
    return t.orders.groupBy("o_orderpriority").agg(R(T.reference_years("o_orderdate", "o_totalprice", ref())["yoy_pct"], 8).alias("yoy_pct"))


@query("reference_year", f"SELECT o_orderkey, year(DATE '{REF}') - year(o_orderdate) AS years_back FROM orders")
def reference_year(t):
    return t.orders.select("o_orderkey", D.diff_years(ref(), c("o_orderdate")).alias("years_back"))


@query("period_over_period_pivot", f"""SELECT o_orderstatus, round(sum(o_totalprice) FILTER (date_diff('month', o_orderdate, DATE '{REF}') = 1), 2) AS last_month,
    round(sum(o_totalprice) FILTER (date_diff('month', o_orderdate, DATE '{REF}') = 2), 2) AS prior_month FROM orders WHERE o_orderdate >= DATE '2000-04-01' AND o_orderdate < DATE '2000-06-01' GROUP BY 1""")
def period_over_period_pivot(t):
    from orrery.operators.filters import last_n_complete_periods, period_distance

    back = period_distance(c("o_orderdate"), "month", ref())
    two = t.orders.filter(last_n_complete_periods(c("o_orderdate"), "month", 2, ref()))
    return two.groupBy("o_orderstatus").agg(
        R(F.sum(F.when(back == 1, c("o_totalprice"))), 2).alias("last_month"), R(F.sum(F.when(back == 2, c("o_totalprice"))), 2).alias("prior_month"))


for _n, _u in (("ytd", "year"), ("qtd", "quarter"), ("mtd", "month"), ("wtd", "week")):
    for _fn, _m, _d in (("sum", "total", 2), ("avg", "n", 6)):  # averages of counts: exact in any order of summation
        query(f"{_n}_{_fn}", f"WITH {BAL}, d AS (SELECT c_mktsegment, day, round(sum(balance), 2) AS total, count(*) AS n FROM b GROUP BY 1, 2) SELECT c_mktsegment, day, round({_fn}({_m}) OVER (PARTITION BY c_mktsegment, date_trunc('{_u}', day) ORDER BY day), {_d}) AS v FROM d")(
            lambda t, u=_u, f=_fn, m=_m, d=_d: T.to_date_measure(
                balances(t).groupBy("c_mktsegment", "day").agg(R(F.sum("balance"), 2).alias("total"), F.count("*").alias("n")),
                ["c_mktsegment"], "day", u, m, "v", f).select("c_mktsegment", "day", R("v", d).alias("v")))


@query("point_in_time_count", """WITH m AS (SELECT c_mktsegment, min(o_orderdate)::DATE AS a, CASE WHEN count(*) > 4 THEN max(o_orderdate)::DATE END AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey),
    d AS (SELECT unnest(generate_series(DATE '1997-01-01', DATE '1997-12-31', INTERVAL 1 DAY))::DATE AS day)
    SELECT c_mktsegment, day, count(*) AS active FROM m JOIN d ON a <= day AND (b IS NULL OR day < b) AND (b IS NULL OR a < b) GROUP BY 1, 2""")
def point_in_time_count(t):
    members = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).groupBy("c_mktsegment", "c_custkey").agg(
        F.min("o_orderdate").alias("a"), F.when(F.count("*") > 4, F.max("o_orderdate")).alias("b"))
    return T.point_in_time_count(members, ["c_mktsegment"], "a", "b", "1997-01-01", "1997-12-31")


for _b, _u in (("HOURLY", "hour"), ("DAILY", "day"), ("WEEKLY", "week"), ("MONTHLY", "month"), ("QUARTERLY", "quarter"), ("YEARLY", "year")):
    _cast = "" if _b == "HOURLY" else "::DATE"
    query(f"same_grain_bucket_{_b.lower()}", f"SELECT event_type, date_trunc('{_u}', ts){_cast} AS period_start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")(
        lambda t, b=_b: r2(T.bucketed(t.events, ["event_type"], "ts", b, {"n": F.count("*"), "total": F.sum("value")}), "total"))


@query("auto_bucket", "SELECT n AS distinct_dates, CASE WHEN n < 100 THEN 'YEARLY' WHEN n <= 1500 THEN 'MONTHLY' WHEN n <= 50000 THEN 'WEEKLY' ELSE 'DAILY' END AS bucket FROM (SELECT count(DISTINCT o_orderdate::DATE) AS n FROM orders)")
def auto_bucket(t):
    return T.auto_bucket(t.orders, "o_orderdate")


@query("cyclic_bucket", "SELECT isodow(o_orderdate) AS dow, month(o_orderdate) AS moy, count(*) AS n FROM orders GROUP BY 1, 2")
def cyclic_bucket(t):
    return t.orders.groupBy(D.day_number_of_week(c("o_orderdate")).alias("dow"), D.month_number(c("o_orderdate")).alias("moy")).agg(F.count("*").alias("n"))


@query("densify_calendar", """WITH g AS (SELECT o_orderpriority, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2),
    s AS (SELECT o_orderpriority, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM g GROUP BY 1) SELECT s.*, g.n FROM s LEFT JOIN g USING (o_orderpriority, day)""")
def densify_calendar(t):
    g = t.orders.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return T.densify_calendar(g, ["o_orderpriority"], "day")
