"""Windows over grouped measures, interval frames, and ranks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalogue.registry import query
from orrery.functions import dates as D
from orrery.operators import windows as V

c = F.col
R = F.round


def monthly(t):
    """Order totals by status and month."""
    return t.orders.groupBy("o_orderstatus", D.date_bucket(c("o_orderdate"), "MONTHLY").alias("month")).agg(
        R(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


def daily(t):
    """Shipped quantity by flag and day; days without shipments are gaps."""
    return t.lineitem.groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("qty"))


M = "(SELECT o_orderstatus, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1, 2)"
DAY = "(SELECT l_returnflag, l_shipdate::DATE AS day, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)"
BY, ORDER = ["o_orderstatus"], ["month"]
OVER = "OVER (PARTITION BY o_orderstatus ORDER BY month {frame})"


def monthly_window(name: str, column, sql: str, digits: int | None = None) -> None:
    """Record a window over the monthly rows."""
    def run(t):
        v = column()
        return monthly(t).select("o_orderstatus", "month", (v if digits is None else R(v, digits)).alias("v"))
    query(name, f"SELECT o_orderstatus, month, {sql if digits is None else f'round({sql}, {digits})'} AS v FROM {M}")(run)


CUM = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
for _fn, _sql, _d in (("sum", "sum", 2), ("average", "avg", 2), ("max", "max", None), ("min", "min", None)):
    monthly_window(f"cumulative_{_fn}", lambda f=_fn: V.cumulative(f, "total", ORDER, BY), f"{_sql}(total) " + OVER.format(frame=CUM), _d)
    monthly_window(f"moving_{_fn}", lambda f=_fn: V.moving(f, "total", 2, 0, ORDER, BY),
                   f"{_sql}(total) " + OVER.format(frame="ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"), _d)
monthly_window("moving_around", lambda: V.moving("sum", "n", 3, 3, ORDER, BY), "sum(n)::BIGINT".replace("::BIGINT", "") + " " + OVER.format(frame="ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING") + "::BIGINT")
monthly_window("moving_exact_row", lambda: V.moving("sum", "total", 3, -3, ORDER, BY), "lag(total, 3) " + OVER.format(frame=""))
monthly_window("lag_n", lambda: V.lag_n("n", 2, ORDER, BY, 0), "lag(n, 2, 0) " + OVER.format(frame=""))
monthly_window("lead_n", lambda: V.lead_n("n", 2, ORDER, BY), "lead(n, 2) " + OVER.format(frame=""))
monthly_window("previous_row", lambda: V.previous_row("total", 1, ORDER, BY), "lag(total) " + OVER.format(frame=""))
monthly_window("peek", lambda: V.peek("n", 1, ORDER, BY), "lag(n) " + OVER.format(frame=""))
monthly_window("window_all", lambda: V.window_all("sum", "total", BY), "sum(total) OVER (PARTITION BY o_orderstatus)", 2)
monthly_window("nth_value", lambda: V.nth_value("total", 3, ORDER, BY), "nth_value(total, 3) " + OVER.format(frame="ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"))
monthly_window("first_value_at", lambda: V.first_value_at("total", ORDER, BY), "first_value(total) " + OVER.format(frame="ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"))
monthly_window("last_value_at", lambda: V.last_value_at("total", ORDER, BY), "last_value(total) " + OVER.format(frame="ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"))
monthly_window("row_offset_first", lambda: V.row_offset_first(ORDER, BY), "1 - row_number() " + OVER.format(frame=""))
monthly_window("row_offset_last", lambda: V.row_offset_last(ORDER, BY), "count(*) OVER (PARTITION BY o_orderstatus) - row_number() " + OVER.format(frame=""))
monthly_window("partition_size", lambda: V.partition_size(BY), "count(*) OVER (PARTITION BY o_orderstatus)")
monthly_window("running_count", lambda: V.running_count(ORDER, BY), "count(*) " + OVER.format(frame=CUM))
monthly_window("moving_stddev", lambda: V.moving("stddev", "total", 5, 0, ORDER, BY), "stddev_samp(total) " + OVER.format(frame="ROWS BETWEEN 5 PRECEDING AND CURRENT ROW"), 4)
monthly_window("moving_count", lambda: V.moving("count", "total", 5, 0, ORDER, BY), "count(total) " + OVER.format(frame="ROWS BETWEEN 5 PRECEDING AND CURRENT ROW"))
monthly_window("moving_median", lambda: V.moving("median", "n", 4, 0, ORDER, BY), "median(n) " + OVER.format(frame="ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"))
monthly_window("window_over_aggregate", lambda: F.try_divide(c("total"), V.window_all("sum", "total", BY)), "total / sum(total) OVER (PARTITION BY o_orderstatus)", 8)
monthly_window("rank_partitioned", lambda: V.rank_partitioned("n", BY), "rank() OVER (PARTITION BY o_orderstatus ORDER BY n DESC)")


def interval(name: str, column, frame: str) -> None:
    """Record a date-interval frame over the daily rows."""
    query(name, f"SELECT l_returnflag, day, sum(qty) OVER (PARTITION BY l_returnflag ORDER BY day RANGE BETWEEN {frame}) AS v FROM {DAY}")(
        lambda t: daily(t).select("l_returnflag", "day", column().alias("v")))


DIMS = ["l_returnflag"]
interval("trailing_interval", lambda: V.trailing_interval("sum", "qty", 7, "day", "day", DIMS), "INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING")
interval("trailing_inclusive", lambda: V.trailing_interval("sum", "qty", 7, "day", "day", DIMS, inclusive=True), "INTERVAL 6 DAY PRECEDING AND CURRENT ROW")
interval("leading_interval", lambda: V.leading_interval("sum", "qty", 3, "day", "day", DIMS), "INTERVAL 1 DAY FOLLOWING AND INTERVAL 3 DAY FOLLOWING")
interval("leading_inclusive", lambda: V.leading_interval("sum", "qty", 3, "day", "day", DIMS, inclusive=True), "CURRENT ROW AND INTERVAL 2 DAY FOLLOWING")


def spend(t):
    return t.orders.groupBy("o_custkey").agg(R(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


SPEND = "(SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1)"


@query("rank", f"SELECT o_custkey, rank() OVER (ORDER BY n DESC) AS rank FROM {SPEND}")
def rank(t):
    return V.rank(spend(t), "n").select("o_custkey", "rank")


@query("rank_percentile", f"SELECT o_custkey, round((1 - percent_rank() OVER (ORDER BY n DESC)) * 100, 6) AS rank_percentile FROM {SPEND}")
def rank_percentile(t):
    return V.global_ranks(spend(t), "n", descending=True).select("o_custkey", R("rank_percentile", 6).alias("rank_percentile"))


for _name, _sql in (("dense_rank", "dense_rank()"), ("percent_rank", "percent_rank()"), ("cume_dist", "cume_dist()")):
    query(_name, f"SELECT o_custkey, {'round(' if _name != 'dense_rank' else ''}{_sql} OVER (ORDER BY n){', 8)' if _name != 'dense_rank' else ''} AS v FROM {SPEND}")(
        lambda t, m=_name: V.global_ranks(spend(t), "n").select("o_custkey", (c(m) if m == "dense_rank" else R(m, 8)).alias("v")))


@query("row_number", f"SELECT o_custkey, row_number() OVER (ORDER BY n DESC, o_custkey) AS v FROM {SPEND}")
def row_number(t):
    return V.global_ranks(spend(t), "n", descending=True, tie="o_custkey").select("o_custkey", c("row_number").alias("v"))


@query("ntile", f"SELECT o_custkey, ntile(7) OVER (ORDER BY n, o_custkey) AS v FROM {SPEND}")
def ntile(t):
    return V.global_ranks(spend(t), "n", tie="o_custkey", tiles=7).select("o_custkey", c("ntile").alias("v"))


@query("field_index", "SELECT p_type, row_number() OVER (ORDER BY p_type) AS field_index FROM (SELECT DISTINCT p_type FROM part)")
def field_index(t):
    return V.field_values(t.part, "p_type")


@query("field_value", "SELECT p_retailprice AS v FROM (SELECT DISTINCT p_retailprice FROM part) QUALIFY row_number() OVER (ORDER BY p_retailprice) = 5")
def field_value(t):
    return V.field_values(t.part, "p_retailprice").filter("field_index = 5").select(c("p_retailprice").alias("v"))


@query("sql_window_in_aggregate", f"SELECT o_orderstatus, month, sum(total) OVER (PARTITION BY o_orderstatus ORDER BY month) AS v FROM {M}".replace("sum(total) OVER (PARTITION BY o_orderstatus ORDER BY month)", "round(sum(total) OVER (PARTITION BY o_orderstatus ORDER BY month), 2)"))
def sql_window_in_aggregate(t):
    running = F.expr("sum(total) OVER (PARTITION BY o_orderstatus ORDER BY month)")
    return monthly(t).select("o_orderstatus", "month", R(running, 2).alias("v"))
