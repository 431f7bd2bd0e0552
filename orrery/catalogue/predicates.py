"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from orrery.catalogue.registry import query
from orrery.catalogue.scalars import scalar
from orrery.functions import text as X
from orrery.operators import filters as Q, sets as S

c = F.col
REF = "2000-06-15"
ref = lambda: F.lit(REF).cast("date")


@query("formula_column", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def formula_column(t):
    charge = c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))
    return t.lineitem.withColumn("charge", F.round(charge, 6)).select("l_orderkey", "l_linenumber", "l_partkey", "charge")


scalar("if_then_else", "events", "event_id",
       v=(lambda: F.when(F.get_json_object("props", "$.missing") > 50, "high").when(c("value") > 20, "mid").otherwise("low"),
          "CASE WHEN value > 20 THEN 'mid' ELSE 'low' END"))
scalar("simple_case", "orders", "o_orderkey",
       v=(lambda: F.when(c("o_orderstatus") == "O", "open").when(c("o_orderstatus") == "F", "filled").otherwise("part"),
          "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'part' END"))
scalar("compare", "part", "p_partkey", eq=(lambda: c("p_size") == 10, "p_size = 10"), ne=(lambda: c("p_size") != 10, "p_size <> 10"),
       lt=(lambda: c("p_size") < 10, "p_size < 10"), le=(lambda: c("p_size") <= 10, "p_size <= 10"),
       gt=(lambda: c("p_size") > 10, "p_size > 10"), ge=(lambda: c("p_size") >= 10, "p_size >= 10"))
scalar("null_safe_eq", "part", "p_partkey",
       v=(lambda: F.nullif(c("p_size"), F.lit(7)).eqNullSafe(F.nullif(c("p_size"), F.lit(8))), "nullif(p_size, 7) IS NOT DISTINCT FROM nullif(p_size, 8)"))
scalar("is_distinct", "part", "p_partkey",
       v=(lambda: ~F.nullif(c("p_size"), F.lit(7)).eqNullSafe(F.lit(9)), "nullif(p_size, 7) IS DISTINCT FROM 9"))


def keep(name: str, table: str, cols: str, predicate, sql: str) -> None:
    """Record a query that filters a table."""
    names = cols.split()
    query(name, f"SELECT {', '.join(names)} FROM {table} WHERE {sql}")(
        lambda t: getattr(t, table).filter(predicate()).select(*names)
    )


ORD = ("orders", "o_orderkey o_custkey o_orderstatus o_orderpriority")
PRT = ("part", "p_partkey p_name p_type p_size")
keep("logic", *ORD, lambda: ((c("o_orderstatus") == "O") | (c("o_totalprice") > 400000)) & ~(c("o_orderpriority") == "5-LOW"),
     "(o_orderstatus = 'O' OR o_totalprice > 400000) AND NOT o_orderpriority = '5-LOW'")
keep("between", *PRT, lambda: c("p_size").between(10, 20), "p_size BETWEEN 10 AND 20")
keep("in_list", *PRT, lambda: c("p_type").isin("PROMO", "SMALL"), "p_type IN ('PROMO', 'SMALL')")
keep("not_in_list", *PRT, lambda: ~c("p_type").isin("PROMO", "SMALL"), "p_type NOT IN ('PROMO', 'SMALL')")
keep("is_null", *PRT, lambda: F.nullif(c("p_size"), F.lit(7)).isNull(), "nullif(p_size, 7) IS NULL")
keep("is_not_null", *PRT, lambda: F.nullif(c("p_size"), F.lit(7)).isNotNull(), "nullif(p_size, 7) IS NOT NULL")
keep("like", *PRT, lambda: c("p_name").like("%d _i%"), "p_name LIKE '%d _i%'")
keep("ilike", *PRT, lambda: c("p_type").ilike("pro%"), "p_type ILIKE 'pro%'")
keep("in_list_nocase", *PRT, lambda: X.in_list_nocase(c("p_type"), ["promo", "Small"]), "lower(p_type) IN ('promo', 'small')")
keep("wild_match", *PRT, lambda: X.wild_match(c("p_name"), "red*", "*ring"), "(p_name LIKE 'red%' OR p_name LIKE '%ring')")

keep("last_n_complete_periods", *ORD, lambda: Q.last_n_complete_periods(c("o_orderdate"), "month", 6, ref()),
     f"date_diff('month', o_orderdate, DATE '{REF}') BETWEEN 1 AND 6")
keep("last_n_with_current", *ORD, lambda: Q.last_n_complete_periods(c("o_orderdate"), "quarter", 3, ref(), include_current=True),
     f"date_diff('quarter', o_orderdate, DATE '{REF}') BETWEEN 0 AND 2")
keep("in_period", *ORD, lambda: Q.in_period(c("o_orderdate"), "quarter", ref(), -1),
     f"date_trunc('quarter', o_orderdate) = date_trunc('quarter', DATE '{REF}' - INTERVAL 3 MONTH)")
keep("in_period_week", *ORD, lambda: Q.in_period(c("o_orderdate"), "week", ref()),
     f"date_trunc('week', o_orderdate) = date_trunc('week', DATE '{REF}')")
keep("year_to_date_filter", *ORD, lambda: Q.year_to_date_filter(c("o_orderdate"), ref()),
     f"o_orderdate >= DATE '2000-01-01' AND o_orderdate <= DATE '{REF}'")
keep("rolling_date_constraint", "lineitem", "l_orderkey l_linenumber l_partkey",
     lambda: Q.rolling_date_constraint([[("l_shipdate", 1, "YEAR"), ("l_shipdate", 2, "QUARTER")], [("l_shipdate", 8, "MONTH")]], ref()),
     f"""l_shipdate <= DATE '{REF}' AND (l_shipdate >= DATE '{REF}' - INTERVAL 1 YEAR OR l_shipdate >= DATE '{REF}' - INTERVAL 6 MONTH)
         AND l_shipdate >= DATE '{REF}' - INTERVAL 8 MONTH""")


@query("model_filter", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000 AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1")
def model_filter(t):
    filters = [
        Q.Filter("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), Q.Filter("o_totalprice", ">", [100000]),
        Q.Filter("o_orderdate", "between", ["01/01/1996", "12/31/1999"]),
    ]
    return Q.model_filter(t.orders, filters).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("table_scoped_filter", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def table_scoped_filter(t):
    filters = [
        Q.Filter("o_totalprice", ">", [100000], tables=["orders", "lineitem"]),
        Q.Filter("o_orderstatus", "=", ["O"], tables=["customer"]),
    ]
    return Q.model_filter(t.orders, filters, used_tables=["orders"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("parameter_filter", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice >= 50000 GROUP BY 1")
def parameter_filter(t):
    priority = Q.Parameter("priority", "CHAR", "1-URGENT", allowed=["1-URGENT", "2-HIGH"])
    floor = Q.Parameter("floor", "DOUBLE", 0.0, low=0.0, high=1e6)
    rows = t.orders.filter((c("o_orderpriority") == priority.value("2-HIGH")) & (c("o_totalprice") >= floor.value(50000.0)))
    return rows.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("boolean_formula_filter", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount > 0.05 AND l_quantity > 25 GROUP BY 1")
def boolean_formula_filter(t):
    deep_bulk = (c("l_discount") > 0.05) & (c("l_quantity") > 25)
    return t.lineitem.filter(deep_bulk).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12")


@query("qualify", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def qualify(t):
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(c("o_totalprice").desc(), "o_orderkey"))
    return S.qualify(t.orders, place, lambda q: q == 1).select("o_custkey", "o_orderkey", "o_totalprice")


@query("select_all_except", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
def select_all_except(t):
    from orrery.sources.tables import select_all_except

    return select_all_except(t.customer, "c_name", "c_acctbal")
