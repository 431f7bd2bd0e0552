"""Joins: star, outer, range, as-of, semi and anti, several facts, lookups, discovery."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from orrery.catalogue.registry import query
from orrery.functions import dates as D
from orrery.operators import joins as J

c = F.col
R = F.round
NET = "l_extendedprice * (1 - l_discount)"
net = lambda: c("l_extendedprice") * (1 - c("l_discount"))


def star(t, how="inner"):
    """lineitem -> orders -> customer -> nation -> region."""
    return J.star_join(
        t.lineitem,
        J.Dim(t.orders, [("l_orderkey", "o_orderkey")], how),
        J.Dim(t.customer, [("o_custkey", "c_custkey")], how),
        J.Dim(t.nation, [("c_nationkey", "n_nationkey")], how),
        J.Dim(t.region, [("n_regionkey", "r_regionkey")], how),
    )


STAR = """lineitem {j} JOIN orders ON l_orderkey = o_orderkey {j} JOIN customer ON o_custkey = c_custkey
    {j} JOIN nation ON c_nationkey = n_nationkey {j} JOIN region ON n_regionkey = r_regionkey"""


@query("star_join_inner", f"""SELECT r_name, date_trunc('year', o_orderdate)::DATE AS order_year, round(sum({NET}), 4) AS revenue, count(*) AS lines
    FROM {STAR.format(j='')} GROUP BY 1, 2""")
def star_join_inner(t):
    return star(t).groupBy("r_name", D.date_bucket(c("o_orderdate"), "YEARLY").alias("order_year")).agg(
        R(F.sum(net()), 4).alias("revenue"), F.count("*").alias("lines")
    )


@query("star_join_left", f"""SELECT r_name, count(*) AS lines, round(sum({NET}), 4) AS revenue
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def star_join_left(t):
    rows = J.star_join(
        t.lineitem,
        J.Dim(t.orders, [("l_orderkey", "o_orderkey")], "left"), J.Dim(t.customer, [("o_custkey", "c_custkey")], "left"),
        J.Dim(t.nation, [("c_nationkey", "n_nationkey")], "left"), J.Dim(t.region, [("n_regionkey", "r_regionkey")], "left"),
    )
    return rows.groupBy("r_name").agg(F.count("*").alias("lines"), R(F.sum(net()), 4).alias("revenue"))


@query("join_right", "SELECT o_orderkey, c_custkey, c_name FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(t):
    return J.star_join(t.orders, J.Dim(t.customer, [("o_custkey", "c_custkey")], "right")).select("o_orderkey", "c_custkey", "c_name")


@query("join_full", "SELECT o_orderkey, c_custkey FROM orders FULL JOIN customer ON o_custkey = c_custkey")
def join_full(t):
    return J.star_join(t.orders, J.Dim(t.customer, [("o_custkey", "c_custkey")], "full")).select("o_orderkey", "c_custkey")


@query("join_cross_scalar", "SELECT o_orderpriority, round(s, 2) AS total, round(g, 2) AS grand_total FROM (SELECT o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY 1) CROSS JOIN (SELECT sum(o_totalprice) AS g FROM orders)")
def join_cross_scalar(t):
    by = t.orders.groupBy("o_orderpriority").agg(R(F.sum("o_totalprice"), 2).alias("total"))
    return J.cross_scalar(by, t.orders.agg(R(F.sum("o_totalprice"), 2).alias("grand_total")))


@query("join_using", "SELECT quality, toxic, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def join_using(t):
    return t.documents.join(t.labels, on=["doc_id"]).groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("join_composite", """SELECT o_orderpriority, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus GROUP BY 1""")
def join_composite(t):
    """Lines that have the status of their order: two tables, two columns as key."""
    met = J.star_join(t.lineitem, J.Dim(t.orders, [("l_orderkey", "o_orderkey"), ("l_linestatus", "o_orderstatus")]))
    return met.groupBy("o_orderpriority").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"))


@query("join_multi_hop", "SELECT r_name, n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_multi_hop(t):
    rows = J.star_join(t.orders, J.Dim(t.customer, [("o_custkey", "c_custkey")]), J.Dim(t.nation, [("c_nationkey", "n_nationkey")]),
                       J.Dim(t.region, [("n_regionkey", "r_regionkey")]))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"))


@query("join_role_playing", f"""SELECT cn.n_name AS buyer_n_name, sn.n_name AS seller_n_name, round(sum({NET}), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2""")
def join_role_playing(t):
    rows = J.star_join(
        t.lineitem, J.Dim(t.orders, [("l_orderkey", "o_orderkey")]), J.Dim(t.customer, [("o_custkey", "c_custkey")]),
        J.Dim(t.supplier, [("l_suppkey", "s_suppkey")]), J.Dim(t.nation, [("c_nationkey", "n_nationkey")], prefix="buyer_"),
        J.Dim(t.nation, [("s_nationkey", "n_nationkey")], prefix="seller_"),
    )
    return rows.groupBy("buyer_n_name", "seller_n_name").agg(R(F.sum(net()), 4).alias("revenue"))


# Price periods per part brand, as a slowly changing dimension made from the parts themselves.
def _periods(t):
    y = F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("i")
    p = t.part.groupBy("p_brand").agg(F.min("p_size").alias("base")).select("p_brand", "base", y)
    start = F.make_date(F.lit(1995) + c("i"), F.lit(1) + c("base") % 6, F.lit(1))
    end = F.make_date(F.lit(1996) + c("i"), F.lit(1) + c("base") % 6, F.lit(1))
    return p.select(
        "p_brand", "i",
        start.cast("timestamp_ntz").alias("valid_from"),
        F.when(c("i") < 5, end.cast("timestamp_ntz")).alias("valid_to"),
    )


_PERIODS = """(SELECT p_brand AS brand, i, make_date(1995 + i, 1 + base % 6, 1)::TIMESTAMP AS valid_from,
    CASE WHEN i < 5 THEN make_date(1996 + i, 1 + base % 6, 1)::TIMESTAMP END AS valid_to
    FROM (SELECT p_brand, min(p_size)::INTEGER AS base FROM part GROUP BY 1), (SELECT unnest(range(6))::INTEGER AS i))"""


@query("join_range", f"""SELECT i, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey
    LEFT JOIN {_PERIODS} v ON v.brand = p_brand AND l_shipdate >= valid_from AND (valid_to IS NULL OR l_shipdate < valid_to) GROUP BY 1""")
def join_range(t):
    lines = J.star_join(t.lineitem, J.Dim(t.part, [("l_partkey", "p_partkey")])).select("l_shipdate", "l_quantity", "p_brand")
    periods = _periods(t).withColumnRenamed("p_brand", "brand")
    rows = J.join_range(lines, periods, "l_shipdate", "valid_from", "valid_to", keys=[("p_brand", "brand")])
    return rows.groupBy("i").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"))


@query("join_date_period", """WITH p AS (SELECT o_orderpriority AS label, min(o_orderdate) + INTERVAL 100 DAY AS a, min(o_orderdate) + INTERVAL 400 DAY AS b FROM orders GROUP BY 1)
    SELECT label, count(*) AS lines FROM lineitem JOIN p ON l_shipdate >= a AND l_shipdate < b GROUP BY 1""")
def join_date_period(t):
    first = F.min("o_orderdate")
    p = t.orders.groupBy(c("o_orderpriority").alias("label")).agg(
        (first + F.expr("INTERVAL '100' DAY")).alias("a"), (first + F.expr("INTERVAL '400' DAY")).alias("b"))
    rows = J.join_range(t.lineitem.select("l_shipdate"), p, "l_shipdate", "a", "b", how="inner")
    return rows.groupBy("label").agg(F.count("*").alias("lines"))


@query("join_tz_bridge", "SELECT (ts + CASE WHEN ts < TIMESTAMP '2024-01-15' THEN INTERVAL 9 HOUR ELSE INTERVAL 10 HOUR END)::DATE AS local_day, count(*) AS n FROM events GROUP BY 1")
def join_tz_bridge(t):
    bridge = t.spark.sql("""SELECT * FROM VALUES ('Z1', TIMESTAMP_NTZ '2023-01-01', TIMESTAMP_NTZ '2024-01-15', 9), ('Z1', TIMESTAMP_NTZ '2024-01-15', CAST(NULL AS TIMESTAMP_NTZ), 10),
        ('Z2', TIMESTAMP_NTZ '2023-01-01', CAST(NULL AS TIMESTAMP_NTZ), 0) AS b(zone, utc_start, utc_end, hours)""")
    mine = bridge.filter(c("zone") == "Z1")
    rows = J.join_range(t.events, mine, "ts", "utc_start", "utc_end")
    local = c("ts") + F.make_interval(hours=c("hours"))
    return rows.groupBy(F.to_date(local).alias("local_day")).agg(F.count("*").alias("n"))


@query("join_asof", """SELECT b.event_id, b.user_id, a.ts AS click_ts, a.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') b
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) a ON a.user_id = b.user_id AND b.ts >= a.ts""")
def join_asof(t):
    e = t.events
    buys = e.filter(c("event_type") == "purchase").select("event_id", "user_id", "ts")
    clicks = e.filter(c("event_type") == "click").select("user_id", c("ts").alias("click_ts"), c("value").alias("click_value"))
    return J.join_asof(buys, clicks, ["user_id"], "ts", "click_ts", ["click_value"]).select("event_id", "user_id", "click_ts", "click_value")


@query("semi_join", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) GROUP BY 1")
def semi_join(t):
    members = J.star_join(t.customer, J.Dim(t.nation, [("c_nationkey", "n_nationkey")])).filter(c("n_regionkey") == 1)
    return J.semi_join(t.orders, members, [("o_custkey", "c_custkey")]).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), R(F.sum("o_totalprice"), 2).alias("total"))


@query("anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def anti_join(t):
    return J.anti_join(t.customer, t.events, [("c_custkey", "user_id")]).select("c_custkey", "c_name")


@query("outer_members", "SELECT c_custkey, round(s, 2) AS events_value FROM customer LEFT JOIN (SELECT user_id, sum(value) AS s FROM events GROUP BY 1) ON c_custkey = user_id")
def outer_members(t):
    out = J.outer_members(t.customer, "c_custkey", t.events, "user_id", {"events_value": R(F.sum("value"), 2)})
    return out.select("c_custkey", "events_value")


@query("drill_across", """WITH s AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, sum(l_quantity) AS shipped FROM lineitem GROUP BY 1),
    o AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS ordered FROM orders GROUP BY 1) SELECT month, shipped, ordered FROM s FULL JOIN o USING (month)""")
def drill_across(t):
    s = t.lineitem.groupBy(D.date_bucket(c("l_shipdate"), "MONTHLY").alias("month")).agg(F.sum("l_quantity").alias("shipped"))
    o = t.orders.groupBy(D.date_bucket(c("o_orderdate"), "MONTHLY").alias("month")).agg(F.count("*").alias("ordered"))
    return J.drill_across([s, o], ["month"])


@query("fan_trap_safe_agg", """SELECT o_orderstatus, round(sum(o_totalprice), 2) AS header_total, sum(qty) AS detail_qty FROM orders
    LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""")
def fan_trap_safe_agg(t):
    rows = J.fan_trap_safe(t.orders, "o_orderkey", t.lineitem, "l_orderkey", {"qty": F.sum("l_quantity")})
    return rows.groupBy("o_orderstatus").agg(R(F.sum("o_totalprice"), 2).alias("header_total"), F.sum("qty").alias("detail_qty"))


@query("blend_left", """WITH a AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS sales FROM orders GROUP BY 1),
    b AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, sum(l_quantity) AS target FROM lineitem GROUP BY 1) SELECT month, sales, target FROM a LEFT JOIN b USING (month)""")
def blend_left(t):
    orders = t.orders.withColumn("month", D.date_bucket(c("o_orderdate"), "MONTHLY"))
    targets = t.lineitem.withColumn("month", D.date_bucket(c("l_shipdate"), "MONTHLY"))
    return J.blend_left(orders, targets, ["month"], {"sales": R(F.sum("o_totalprice"), 2)}, {"target": F.sum("l_quantity")})


@query("augment_join", "SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 3 END::BIGINT AS sla_days FROM orders")
def augment_join(t):
    uploaded = t.spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 3)], "o_orderpriority string, sla_days bigint")
    return J.augment_join(t.orders, uploaded, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", "sla_days")


@query("map_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE 'Other' END AS label FROM orders")
def map_lookup(t):
    mapping = t.spark.createDataFrame([("O", "Open"), ("F", "Filled")], "k string, v string")
    return J.map_lookup(t.orders, "o_orderstatus", mapping, "label", "Other").select("o_orderkey", "label")


@query("lookup_value", "SELECT c_custkey, f.o_orderdate::DATE AS first_order FROM customer LEFT JOIN (SELECT o_custkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) f ON f.o_custkey = c_custkey")
def lookup_value(t):
    out = J.lookup_value(t.customer, "c_custkey", t.orders, "o_custkey", "o_orderdate", ["o_orderkey"], "first_order")
    return out.select("c_custkey", F.to_date("first_order").alias("first_order"))


@query("exists_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def exists_in(t):
    return J.exists_in(t.orders, t.events, [("o_custkey", "user_id")]).select("o_orderkey", "o_custkey")


_PAIRS = [  # (source table, column, target table, column) that share a name once prefixes are cut
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("customer", "c_custkey", "orders", "o_custkey"),
]
_DISC = """SELECT * FROM (SELECT '{s}' AS source_table, '{sc}' AS source_column, '{t}' AS target_table, '{tc}' AS target_column,
    (SELECT count({tc}) FROM {t}) AS target_rows, (SELECT count(DISTINCT {tc}) FROM {t}) AS target_keys,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM {s} GROUP BY {sc})) AS max_rows_per_key,
    CASE WHEN (SELECT max(n) FROM (SELECT count(*) AS n FROM {s} GROUP BY {sc})) = 1 THEN 'ONE_TO_ONE' ELSE 'MANY_TO_ONE' END AS cardinality,
    (SELECT count(DISTINCT {sc}) FROM {s} WHERE {sc} IN (SELECT {tc} FROM {t})) / (SELECT count(DISTINCT {sc}) FROM {s})::DOUBLE AS inclusion) WHERE target_rows = target_keys"""


@query("discover_joins", " UNION ALL ".join(_DISC.format(s=s, sc=sc, t=u, tc=uc) for s, sc, u, uc in _PAIRS))
def discover_joins(t):
    cut = lambda name: re.sub(r"^[a-z]_", "", name.lower())
    return J.discover_joins({"orders": t.orders, "lineitem": t.lineitem, "customer": t.customer}, cut)
