"""Bins, groups, cohorts, funnels, order, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalogue.registry import query
from orrery.catalogue.scalars import scalar
from orrery.operators import aggregates as G, sets as S
from orrery.operators.filters import Parameter

c = F.col
R = F.round

scalar("bin_fixed", "part", "p_partkey", v=(lambda: S.bin_fixed(c("p_size"), 5, 45, 8), "CASE WHEN p_size >= 5 AND p_size < 45 THEN (p_size - 5) // 8 END"))
scalar("bin_dynamic", "customer", "c_custkey", v=(lambda: S.bin_dynamic(c("c_acctbal"), Parameter("size", "DOUBLE", 500.0).value(750.0)), "floor(c_acctbal / 750) * 750"))
scalar("tier", "part", "p_partkey", v=(lambda: S.tier(c("p_size"), [10, 25, 40], ["tiny", "small", "medium", "large"]),
       "CASE WHEN p_size < 10 THEN 'tiny' WHEN p_size < 25 THEN 'small' WHEN p_size < 40 THEN 'medium' ELSE 'large' END"))
scalar("group_based", "part", "p_partkey",
       v=(lambda: S.group_based([
           S.Group("core", [("p_type", "IN", ["PROMO", "SMALL"]), ("p_size", "BW", [10, 30])]),
           S.Group("edge", [("p_size", "LT", [5]), ("p_size", "GE", [48])], "ANY"),
           S.Group("rest", [("p_type", "NOT_IN", ["LARGE"]), ("p_size", "NE", [20]), ("p_size", "GT", [15]), ("p_size", "LE", [40])]),
           S.Group("economy", [("p_type", "EQ", ["ECONOMY"])]),
       ], "none"),
          """CASE WHEN p_type IN ('PROMO', 'SMALL') AND p_size BETWEEN 10 AND 30 THEN 'core' WHEN p_size < 5 OR p_size >= 48 THEN 'edge'
             WHEN p_type <> 'LARGE' AND p_size <> 20 AND p_size > 15 AND p_size <= 40 THEN 'rest' WHEN p_type = 'ECONOMY' THEN 'economy' ELSE 'none' END"""))
scalar("set_static", "part", "p_partkey",
       v=(lambda: S.set_static(F.nullif(c("p_size"), F.lit(7)), [1, 2, 3, None]), "p_size IN (1, 2, 3, 7)"))
scalar("set_except_members", "part", "p_partkey",
       v=(lambda: S.set_static(F.nullif(c("p_size"), F.lit(7)), [1, 2, 3], exclude=True), "p_size NOT IN (1, 2, 3)"))
scalar("set_intersect_members", "part", "p_partkey",
       v=(lambda: S.set_static(c("p_type"), ["PROMO", "SMALL"]) & S.set_static(c("p_size"), [10, 20, 30]), "p_type IN ('PROMO', 'SMALL') AND p_size IN (10, 20, 30)"))


@query("manual_group_map", "SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'cheap' WHEN p_type = 'LARGE' THEN 'big' ELSE 'other' END AS grp FROM part")
def manual_group_map(t):
    return S.manual_group_map(t.part, "p_type", {"cheap": ["PROMO", "ECONOMY"], "big": ["LARGE"]}, "grp", "other").select("p_partkey", "grp")


@query("value_alias", "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Cars' WHEN 'BUILDING' THEN 'Houses' ELSE c_mktsegment END AS label FROM customer")
def value_alias(t):
    return S.value_alias(t.customer, "c_mktsegment", {"AUTOMOBILE": "Cars", "BUILDING": "Houses"}, "label").select("c_custkey", "label")


@query("drill_path", "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderstatus, grouping(year(o_orderdate)) * 4 + grouping(quarter(o_orderdate)) * 2 + grouping(o_orderstatus) AS grouping_id, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate), quarter(o_orderdate), o_orderstatus)")
def drill_path(t):
    levels = t.orders.select(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), "o_orderstatus")
    return G.grouping(levels, "rollup", ["y", "q", "o_orderstatus"], {"n": F.count("*")})


SPEND = "(SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)"
TOP = f"(SELECT o_custkey FROM {SPEND} QUALIFY rank() OVER (ORDER BY total DESC) <= 20)"
BOTTOM = f"(SELECT o_custkey FROM {SPEND} QUALIFY rank() OVER (ORDER BY total) <= 20)"
spend = lambda: R(F.sum("o_totalprice"), 2)
BY_STATUS = "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey {op} GROUP BY 1"
by_status = lambda df: df.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("set_topn", BY_STATUS.format(op=f"IN {TOP}"))
def set_topn(t):
    return by_status(S.keep_members(t.orders, "o_custkey", S.ranked_members(t.orders, "o_custkey", spend(), 20)))


@query("set_bottomn", BY_STATUS.format(op=f"IN {BOTTOM}"))
def set_bottomn(t):
    return by_status(S.keep_members(t.orders, "o_custkey", S.ranked_members(t.orders, "o_custkey", spend(), 20, top=False)))


@query("set_except_topn", BY_STATUS.format(op=f"NOT IN {TOP}"))
def set_except_topn(t):
    return by_status(S.drop_members(t.orders, "o_custkey", S.ranked_members(t.orders, "o_custkey", spend(), 20)))


COND = "(SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12 AND avg(o_totalprice) > 250000)"
cond = lambda t: S.condition_members(t.orders, "o_custkey", {"n": F.count("*"), "a": F.avg("o_totalprice")}, (c("n") >= 12) & (c("a") > 250000))


@query("set_condition", BY_STATUS.format(op=f"IN {COND}"))
def set_condition(t):
    return by_status(S.keep_members(t.orders, "o_custkey", cond(t)))


@query("set_mixed", f"SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN {COND} AND c_custkey NOT IN {TOP}")
def set_mixed(t):
    members = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    flagged = S.in_set(S.in_set(members, "o_custkey", cond(t), "loyal"), "o_custkey", S.ranked_members(t.orders, "o_custkey", spend(), 20), "top")
    mixed = S.set_static(c("c_mktsegment"), ["BUILDING", "MACHINERY"]) & c("loyal") & ~c("top")
    return flagged.filter(mixed).select(c("o_custkey").alias("c_custkey"))


@query("topn_with_others", """WITH b AS (SELECT p_brand, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY qty DESC) AS k FROM b)
    SELECT CASE WHEN k <= 5 THEN p_brand ELSE 'Others' END AS p_brand, k > 5 AS is_rest, sum(qty) AS l_quantity FROM r GROUP BY 1, 2""")
def topn_with_others(t):
    lines = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).groupBy("p_brand").agg(F.sum("l_quantity").alias("l_quantity"))
    return S.topn_with_others(lines, "p_brand", "l_quantity", 5)


@query("set_filter_passthrough", """SELECT o_custkey FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) QUALIFY rank() OVER (ORDER BY total DESC) <= 10""")
def set_filter_passthrough(t):
    outer = {"o_orderstatus": c("o_orderstatus") == "O", "o_orderpriority": c("o_orderpriority") == "1-URGENT"}
    return S.set_query(t.orders, "o_custkey", spend(), 10, outer, include=["o_orderstatus"])


@query("event_funnel", """WITH f AS (SELECT user_id, ts::DATE AS day, min(ts) FILTER (event_type = 'view') AS a, min(ts) FILTER (event_type = 'click') AS b, min(ts) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1, 2)
    SELECT day, count(a) AS step_1, count(*) FILTER (a < b) AS step_2, count(*) FILTER (a < b AND b < p) AS step_3 FROM f GROUP BY 1""")
def event_funnel(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    return S.event_funnel(e, ["user_id"], "ts", "event_type", ["view", "click", "purchase"], ["day"])


# --- order, top-k, set operations -----------------------------------------------------------
@query("order_by", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment DESC, c_acctbal, c_custkey")
def order_by(t):
    return S.order_by(t.customer, ("c_mktsegment", "desc"), ("c_acctbal", "asc"), ("c_custkey", "asc")).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("order_custom", "SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS place FROM orders GROUP BY 1")
def order_custom(t):
    place = S.custom_position(c("o_orderpriority"), ["3-MEDIUM", "1-URGENT"])
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place")


@query("limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def limit(t):
    return S.top_k(t.orders, 25, ("o_totalprice", "asc"), ("o_orderkey", "asc")).select("o_orderkey", "o_totalprice")


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(t):
    return S.top_k(t.orders, 25, ("o_totalprice", "desc"), ("o_orderkey", "asc")).select("o_orderkey", "o_totalprice")


@query("topn_per_group", "SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 10")
def topn_per_group(t):
    rows = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    return S.topn_per_group(rows, ["o_orderpriority"], 10, ("o_totalprice", "desc"), ("o_orderkey", "asc"))


@query("topn_per_group_ties", "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_extendedprice DESC) AS rank FROM lineitem QUALIFY rank <= 10")
def topn_per_group_ties(t):
    return S.topn_per_group(t.lineitem, ["l_returnflag"], 10, ("l_quantity", "desc"), ("l_extendedprice", "desc"), ties=True).select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "rank")


C1, C2 = "SELECT o_custkey FROM orders", "SELECT user_id AS o_custkey FROM events"
one = lambda t: t.orders.select("o_custkey")
two = lambda t: t.events.select(c("user_id").cast("bigint").alias("o_custkey"))
query("union_all", f"{C1} UNION ALL {C2}")(lambda t: one(t).union(two(t)))
query("union_distinct", f"{C1} UNION {C2}")(lambda t: one(t).union(two(t)).distinct())
query("except", f"{C1} EXCEPT {C2}")(lambda t: one(t).subtract(two(t)))
query("except_all", f"{C1} EXCEPT ALL {C2}")(lambda t: one(t).exceptAll(two(t)))
query("intersect", f"{C1} INTERSECT {C2}")(lambda t: one(t).intersect(two(t)))
query("intersect_all", f"{C1} INTERSECT ALL {C2}")(lambda t: one(t).intersectAll(two(t)))
query("union_typed", f"{C1} UNION ALL SELECT c_custkey FROM customer")(lambda t: S.union_typed(one(t), t.customer.select("c_custkey")))
