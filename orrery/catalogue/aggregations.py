"""Aggregations: plain, statistical, conditional, nested and multi-level."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalogue.registry import query
from orrery.functions import aggregates as A, numbers as N
from orrery.operators import aggregates as G, joins as J
from orrery.operators.keys import beside_group
from orrery.session import settled

c = F.col
NET = "l_extendedprice * (1 - l_discount)"
net = lambda: c("l_extendedprice") * (1 - c("l_discount"))


def grouped(name: str, table: str, keys: str, **cols) -> None:
    """Record a query of aggregates by the keys of a table."""
    ids = keys.split()
    sql = f"SELECT {', '.join([*ids, *(f'{s} AS {n}' for n, (_, s) in cols.items())])} FROM {table} GROUP BY {', '.join(ids)}"
    query(name, sql)(lambda t: getattr(t, table).groupBy(*ids).agg(*[f().alias(n) for n, (f, _) in cols.items()]))


R = F.round
FLAG = ("lineitem", "l_returnflag l_linestatus")
grouped("agg_sum", *FLAG, v=(lambda: R(F.sum("l_extendedprice"), 2), "round(sum(l_extendedprice), 2)"))
grouped("agg_avg", *FLAG, v=(lambda: R(F.avg("l_extendedprice"), 4), "round(avg(l_extendedprice), 4)"))
grouped("agg_min", *FLAG, v=(lambda: F.min("l_extendedprice"), "min(l_extendedprice)"))
grouped("agg_max", *FLAG, v=(lambda: F.max("l_shipdate"), "max(l_shipdate)"))
grouped("agg_count", "part", "p_type", v=(lambda: F.count(F.nullif(c("p_size"), F.lit(7))), "count(nullif(p_size, 7))"))
grouped("agg_count_rows", "part", "p_type", v=(lambda: F.count("*"), "count(*)"))
grouped("agg_unique_count", *FLAG, v=(lambda: F.count_distinct("l_partkey"), "count(DISTINCT l_partkey)"))
grouped("agg_sum_distinct", "part", "p_type", v=(lambda: F.sum_distinct("p_size"), "sum(DISTINCT p_size)::BIGINT"))
grouped("agg_stddev", *FLAG, v=(lambda: R(F.stddev_samp("l_quantity"), 6), "round(stddev_samp(l_quantity), 6)"),
        p=(lambda: R(F.stddev_pop("l_quantity"), 6), "round(stddev_pop(l_quantity), 6)"))
grouped("agg_variance", *FLAG, v=(lambda: R(F.var_samp("l_quantity"), 6), "round(var_samp(l_quantity), 6)"),
        p=(lambda: R(F.var_pop("l_quantity"), 6), "round(var_pop(l_quantity), 6)"))
grouped("agg_stddev_pop", *FLAG, v=(lambda: R(F.stddev_pop("l_discount"), 8), "round(stddev_pop(l_discount), 8)"))
grouped("agg_variance_pop", *FLAG, v=(lambda: R(F.var_pop("l_discount"), 10), "round(var_pop(l_discount), 10)"))
grouped("agg_only", "nation", "n_regionkey", many=(lambda: A.only(c("n_name")), "CASE WHEN count(DISTINCT n_name) = 1 THEN max(n_name) END"),
        one=(lambda: A.only(c("n_regionkey") * 2), "CASE WHEN count(DISTINCT n_regionkey * 2) = 1 THEN max(n_regionkey * 2)::BIGINT END"))
grouped("agg_count_duplicates", "orders", "o_orderstatus", v=(lambda: A.count_duplicates(c("o_custkey")), "count(o_custkey) - count(DISTINCT o_custkey)"))
grouped("row_iterator_agg", *FLAG, v=(lambda: R(F.sum(net()), 4), f"round(sum({NET}), 4)"))
grouped("agg_correl", *FLAG, v=(lambda: R(F.corr("l_quantity", "l_extendedprice"), 6), "round(corr(l_quantity, l_extendedprice), 6)"))
grouped("agg_covar", *FLAG, v=(lambda: R(F.covar_samp("l_quantity", "l_discount"), 6), "round(covar_samp(l_quantity, l_discount), 6)"))
grouped("agg_slope", *FLAG, v=(lambda: R(F.regr_slope("l_extendedprice", "l_quantity"), 4), "round(regr_slope(l_extendedprice, l_quantity), 4)"))
query("agg_kurtosis", "SELECT l_returnflag, round(kurtosis_pop(l_quantity), 6) AS v FROM lineitem GROUP BY 1")(
    lambda t: t.lineitem.groupBy("l_returnflag").agg(R(F.kurtosis("l_quantity"), 6).alias("v")))
query("agg_skew", """SELECT l_returnflag, round(avg(pow(d, 3)) / pow(avg(d * d), 1.5), 6) AS v FROM
    (SELECT l_returnflag, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS d FROM lineitem) GROUP BY 1""")(
    lambda t: t.lineitem.groupBy("l_returnflag").agg(R(F.skewness("l_extendedprice"), 6).alias("v")))


@query("agg_approx_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, true AS within FROM lineitem GROUP BY 1")
def agg_approx_distinct(t):
    """A sketch beside the exact count: is it within 6 %, three standard errors?"""
    by = t.lineitem.groupBy("l_returnflag")
    near = by.agg(F.approx_count_distinct("l_orderkey", 0.02).alias("_near"))
    both = by.agg(F.count_distinct("l_orderkey").alias("orders")).join(near, "l_returnflag")
    return both.select("l_returnflag", "orders", (F.abs(c("_near") - c("orders")) <= 0.06 * c("orders")).alias("within"))


@query("agg_sum_distinct_key", """SELECT o_orderstatus, round(sum(p), 2) AS total FROM
    (SELECT o_orderstatus, o_orderkey, max(o_totalprice) AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1""")
def agg_sum_distinct_key(t):
    lines = t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"))
    return G.sum_distinct_key(lines, ["o_orderstatus"], "o_orderkey", "o_totalprice", "total").withColumn("total", R("total", 2))


@query("agg_median", "SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2")
def agg_median(t):
    return G.percentiles(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"v": (0.5, "cont")})


@query("agg_percentile_cont", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25 FROM lineitem GROUP BY 1")
def agg_percentile_cont(t):
    out = G.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p90": (0.9, "cont"), "p25": (0.25, "cont")})
    return out.select("l_returnflag", R("p90", 6).alias("p90"), R("p25", 6).alias("p25"))


@query("agg_percentile_disc", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY 1")
def agg_percentile_disc(t):
    return G.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p90": (0.9, "disc")})


@query("agg_percentile_approx", "SELECT l_returnflag, count(*) AS lines, true AS within FROM lineitem GROUP BY 1")
def agg_percentile_approx(t):
    """A sketch beside exact counts: do at least 89.9 % of the rows reach up to it, and at most 90.1 % stay below?"""
    near = settled(t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.9, 10_000).alias("_p"), F.count("*").alias("_size")))
    both = beside_group(t.lineitem, near, ["l_returnflag"], "_size")
    below, upto = (F.count(F.when(x, 1)) for x in (c("l_extendedprice") < c("_p"), c("l_extendedprice") <= c("_p")))
    n = F.count("*")
    return both.groupBy("l_returnflag").agg(n.alias("lines"), ((upto >= 0.899 * n) & (below <= 0.901 * n)).alias("within"))


@query("agg_fractile", "SELECT round(quantile_cont(o_totalprice, 0.9), 6) AS f FROM orders")
def agg_fractile(t):
    return G.percentiles(t.orders, [], "o_totalprice", {"f": (0.9, "cont")}).select(R("f", 6).alias("f"))


@query("agg_quartile", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.5), 6) AS q2, round(quantile_cont(o_totalprice, 0.75), 6) AS q3 FROM orders GROUP BY 1")
def agg_quartile(t):
    out = G.percentiles(t.orders, ["o_orderstatus"], "o_totalprice", {f"q{i}": (i / 4, "cont") for i in (1, 2, 3)})
    return out.select("o_orderstatus", *[R(f"q{i}", 6).alias(f"q{i}") for i in (1, 2, 3)])


@query("agg_mode", """SELECT p_brand, p_size::BIGINT AS v FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS r
    FROM part GROUP BY 1, 2) WHERE r = 1""")
def agg_mode(t):
    return G.mode(t.part, ["p_brand"], "p_size", "v")


@query("agg_string_list", "SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types FROM part GROUP BY 1")
def agg_string_list(t):
    return G.string_list(t.part, ["p_brand"], "p_type", "types")


@query("agg_largest_n", "SELECT o_orderstatus, o_totalprice AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) = 3")
def agg_largest_n(t):
    return G.nth_by_value(t.orders, ["o_orderstatus"], "o_totalprice", 3, "v")


@query("agg_smallest_n", "SELECT l_returnflag, l_quantity AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) = 900")
def agg_smallest_n(t):
    return G.nth_by_value(t.lineitem, ["l_returnflag"], "l_quantity", 900, "v", largest=False)


for _fn, _sql, _x, _d in (
    ("sum_if", "sum(l_quantity)", "l_quantity", None), ("count_if", "count(l_quantity)", "l_quantity", None),
    ("unique_count_if", "count(DISTINCT l_partkey)", "l_partkey", None), ("average_if", "avg(l_quantity)", "l_quantity", 6),
    ("min_if", "min(l_extendedprice)", "l_extendedprice", None), ("max_if", "max(l_extendedprice)", "l_extendedprice", None),
    ("stddev_if", "stddev_samp(l_quantity)", "l_quantity", 6), ("variance_if", "var_samp(l_quantity)", "l_quantity", 6),
):
    _f = f"{_sql} FILTER (l_discount > 0.05)"
    grouped(_fn, *FLAG, v=(
        lambda fn=_fn, x=_x, d=_d: (lambda e: e if d is None else R(e, d))(getattr(A, fn)(c("l_discount") > 0.05, c(x))),
        _f if _d is None else f"round({_f}, {_d})"))

grouped("filtered_measure_multi", *FLAG,
        v=(lambda: A.sum_if((c("l_discount") > 0.05) & (c("l_quantity") > 30), c("l_quantity")), "sum(l_quantity) FILTER (l_discount > 0.05 AND l_quantity > 30)"))
grouped("ratio_of_sums", *FLAG, v=(lambda: R(A.ratio_of_sums(c("l_extendedprice"), c("l_quantity")), 6), "round(sum(l_extendedprice) / sum(l_quantity), 6)"))
grouped("weighted_average", *FLAG, v=(lambda: R(A.weighted_average(c("l_discount"), c("l_extendedprice")), 8), "round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 8)"))
grouped("avg_per", "orders", "o_orderstatus", v=(lambda: R(A.average_per(c("o_totalprice"), c("o_custkey")), 4), "round(sum(o_totalprice) / count(DISTINCT o_custkey), 4)"))


@query("cross_measure", f"SELECT l_returnflag, round(rev / cnt, 4) AS per_line, round(rev / qty, 4) AS per_unit FROM (SELECT l_returnflag, sum({NET}) AS rev, count(*) AS cnt, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)")
def cross_measure(t):
    base = t.lineitem.groupBy("l_returnflag").agg(F.sum(net()).alias("rev"), F.count("*").alias("cnt"), F.sum("l_quantity").alias("qty"))
    return base.select("l_returnflag", R(N.ratio(c("rev"), c("cnt")), 4).alias("per_line"), R(N.ratio(c("rev"), c("qty")), 4).alias("per_unit"))


@query("pivot_by_condition", "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS open, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS filled FROM orders GROUP BY 1")
def pivot_by_condition(t):
    out = G.pivot_by_condition(t.orders, ["o_orderpriority"], c("o_orderstatus"), {"open": "O", "filled": "F"}, c("o_totalprice"))
    return out.select("o_orderpriority", R("open", 2).alias("open"), R("filled", 2).alias("filled"))


@query("pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("unpivot_columns", """
    WITH w AS (SELECT o_orderpriority, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1996), 2) AS _1996, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1997), 2) AS _1997 FROM orders GROUP BY 1)
    SELECT o_orderpriority, DATE '1996-01-01' AS year_start, _1996 AS total FROM w UNION ALL SELECT o_orderpriority, DATE '1997-01-01', _1997 FROM w""")
def unpivot_columns(t):
    from orrery.functions.dates import parse_fiscal_label

    wide = G.pivot_by_condition(t.orders, ["o_orderpriority"], F.year("o_orderdate"), {"_1996": 1996, "_1997": 1997}, c("o_totalprice"))
    long = G.unpivot_columns(wide, ["o_orderpriority"], ["_1996", "_1997"], "label", "total")
    label = F.concat(F.lit("FY"), F.right("label", F.lit(4)))
    return long.select("o_orderpriority", parse_fiscal_label(label).alias("year_start"), R("total", 2).alias("total"))


@query("nested_aggregate", "SELECT c_mktsegment, round(avg(n), 6) AS avg_orders, max(n) AS max_orders FROM (SELECT c_mktsegment, c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2) GROUP BY 1")
def nested_aggregate(t):
    rows = t.customer.join(t.orders, c("c_custkey") == c("o_custkey"))
    out = G.nested_aggregate(rows, ["c_mktsegment", "c_custkey"], {"n": F.count("*")}, ["c_mktsegment"],
                             {"avg_orders": F.avg("n"), "max_orders": F.max("n")})
    return out.withColumn("avg_orders", R("avg_orders", 6))


@query("metric_on_metric", "SELECT o_orderstatus, round(avg(n), 6) AS avg_lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1")
def metric_on_metric(t):
    out = G.metric_on_metric(t.lineitem, "l_orderkey", {"n": F.count("*")}, t.orders, "o_orderkey", ["o_orderstatus"], {"avg_lines": F.avg("n")})
    return out.withColumn("avg_lines", R("avg_lines", 6))


@query("cross_fact_ratio", """
    WITH s AS (SELECT year(l_shipdate) AS y, sum(l_quantity) AS qty FROM lineitem GROUP BY 1), o AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)
    SELECT y, round(qty / n, 6) AS qty_per_order FROM s FULL JOIN o USING (y)""")
def cross_fact_ratio(t):
    s = t.lineitem.groupBy(F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("qty"))
    o = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return J.drill_across([s, o], ["y"]).select("y", R(N.ratio(c("qty"), c("n")), 6).alias("qty_per_order"))


@query("stat_over_aggregate", "SELECT p_brand, round(s, 2) AS total, round(avg(s) OVER (), 4) AS mean, round(stddev_samp(s) OVER (), 4) AS std_dev FROM (SELECT p_brand, sum(p_retailprice) AS s FROM part GROUP BY 1)")
def stat_over_aggregate(t):
    out = G.stat_over_aggregate(t.part, ["p_brand"], F.sum("p_retailprice"), "total")
    return out.select("p_brand", R("total", 2).alias("total"), R("mean", 4).alias("mean"), R("std_dev", 4).alias("std_dev"))


@query("outlier_flag", """SELECT o_custkey, round((s - avg(s) OVER ()) / stddev_samp(s) OVER (), 6) AS z_score, abs((s - avg(s) OVER ()) / stddev_samp(s) OVER ()) > 2 AS is_outlier
    FROM (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1)""")
def outlier_flag(t):
    out = G.outlier_flag(t.orders, ["o_custkey"], F.sum("o_totalprice"), "total", 2.0)
    return out.select("o_custkey", R("z_score", 6).alias("z_score"), "is_outlier")


_GS = "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS grouping_id, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY "
_MS = lambda: {"n": F.count("*"), "qty": F.sum("l_quantity")}
_TWO = ["l_returnflag", "l_linestatus"]
query("grouping_sets", _GS + "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")(
    lambda t: G.grouping(t.lineitem, "sets", _TWO, _MS(), [_TWO, ["l_linestatus"], []]))
query("rollup", _GS + "ROLLUP (l_returnflag, l_linestatus)")(lambda t: G.grouping(t.lineitem, "rollup", _TWO, _MS()))
query("cube", _GS + "CUBE (l_returnflag, l_linestatus)")(lambda t: G.grouping(t.lineitem, "cube", _TWO, _MS()))
