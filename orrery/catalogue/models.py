"""Questions to a semantic model over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalogue.joins import NET, STAR
from orrery.catalogue.registry import query
from orrery.operators import rollups as P
from orrery.operators.filters import Filter, Parameter
from orrery.operators.lod import Grouping
from orrery.operators.security import User, row_filter_variable
from orrery.plans import model as M, stages as G
from orrery.session import fresh_path

c = F.col
R = F.round


def trade(t) -> M.Model:
    """Two facts: lines (with orders) and orders themselves; customer geography hangs on orders."""
    return M.Model(
        tables=[M.Table(n, getattr(t, n)) for n in ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")]
        + [M.Table("seller_nation", t.nation, prefix="seller_")],
        joins=[
            M.Join("lineitem", "orders", [("l_orderkey", "o_orderkey")]), M.Join("orders", "customer", [("o_custkey", "c_custkey")]),
            M.Join("customer", "nation", [("c_nationkey", "n_nationkey")]), M.Join("nation", "region", [("n_regionkey", "r_regionkey")]),
            M.Join("lineitem", "part", [("l_partkey", "p_partkey")], "left"), M.Join("lineitem", "supplier", [("l_suppkey", "s_suppkey")], "left"),
            M.Join("supplier", "seller_nation", [("s_nationkey", "seller_n_nationkey")], "left"),
        ],
        attributes=[
            M.Attribute("region", "region", "r_name"), M.Attribute("nation", "nation", "n_name"), M.Attribute("segment", "customer", "c_mktsegment"),
            M.Attribute("seller", "seller_nation", "seller_n_name"), M.Attribute("brand", "part", "p_brand"),
            M.Attribute("order_year", "orders", "o_orderdate", bucket="YEARLY"), M.Attribute("order_month", "orders", "o_orderdate", bucket="MONTHLY"),
        ],
        measures=[
            M.Measure("revenue", "lineitem", "round(sum(net), 4)", uses=("net",), parts=P.Measure("", "SUM", "net"), digits=4), M.Measure("charge", "lineitem", "round(sum(charge), 4)", uses=("charge",)),
            M.Measure("lines", "lineitem", "count(l_orderkey)", parts=P.Measure("", "COUNT", "l_orderkey")), M.Measure("orders", "orders", "count(o_orderkey)"),
            M.Measure("order_total", "orders", "round(sum(o_totalprice), 2)"), M.Measure("closing", "orders", "o_totalprice", last_by="o_orderdate"),
        ],
        formulas=[
            M.Formula("net", ("lineitem",), "l_extendedprice * (1 - l_discount)"), M.Formula("charge", ("lineitem",), "net * (1 + l_tax)", uses=("net",)),
            M.Formula("is_live", ("orders",), "o_orderstatus <> 'P'"),
        ],
        parameters=[Parameter("least", "DOUBLE", 0.0, low=0.0)],
        filters=[Filter("is_live", "=", [True]), Filter("p_size", "<", [40], tables=["part"])],
        row_rules=[M.RowRule("region", lambda u: row_filter_variable(c("r_name"), u, "region"), columns=("r_name",))],
        column_rules=[("charge", "finance")],
    )


LIVE = f"(SELECT *, {NET} AS net FROM {STAR.format(j='')} WHERE o_orderstatus <> 'P')"


@query("model_query", f"SELECT r_name AS region, date_trunc('year', o_orderdate)::DATE AS order_year, round(sum(net), 4) AS revenue, count(*) AS lines FROM {LIVE} GROUP BY 1, 2")
def model_query(t):
    return trade(t).query(["region", "order_year"], ["revenue", "lines"], unsecured=True)


@query("prune_joins", f"SELECT c_mktsegment AS segment, round(sum(net), 4) AS revenue FROM {LIVE} GROUP BY 1")
def prune_joins(t):
    """Part and supplier hang on left joins and are not read; the inner joins all stay."""
    return trade(t).query(["segment"], ["revenue"], unsecured=True)


@query("model_scoped_filter", f"SELECT p_brand AS brand, count(*) AS lines FROM {LIVE} LEFT JOIN part ON l_partkey = p_partkey WHERE p_size < 40 GROUP BY 1")
def model_scoped_filter(t):
    return trade(t).query(["brand"], ["lines"], unsecured=True)


@query("model_two_facts", f"""SELECT region, lines, order_total FROM (SELECT r_name AS region, count(*) AS lines FROM {LIVE} GROUP BY 1) FULL JOIN
    (SELECT r_name AS region, round(sum(o_totalprice), 2) AS order_total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus <> 'P' GROUP BY 1) USING (region)""")
def model_two_facts(t):
    """Order totals are not multiplied by the lines."""
    return trade(t).query(["region"], ["lines", "order_total"], unsecured=True)


@query("model_semi_additive", """WITH b AS (SELECT c_mktsegment AS segment, o_orderdate, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')
    SELECT b.segment, any_value(n) AS orders, round(sum(o_totalprice), 2) AS closing FROM b JOIN (SELECT segment, max(o_orderdate) AS d, count(*) AS n FROM b GROUP BY 1) e ON b.segment = e.segment AND b.o_orderdate = e.d GROUP BY 1""")
def model_semi_additive(t):
    return trade(t).query(["segment"], ["orders", "closing"], unsecured=True).withColumn("closing", R("closing", 2))


@query("model_dimension_only", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def model_dimension_only(t):
    """Without a measure only the dimension tables are read."""
    return trade(t).query(["nation", "region"], unsecured=True)


@query("model_parameter", f"SELECT n_name AS nation, count(*) AS lines FROM {LIVE} WHERE o_totalprice >= 300000 GROUP BY 1 HAVING count(*) > 100")
def model_parameter(t):
    return trade(t).query(["nation"], ["lines"], filters=[(("orders",), (), "o_totalprice >= {least}")], parameters={"least": 300000.0}, having="lines > 100", unsecured=True)


@query("model_row_rule", f"SELECT c_mktsegment AS segment, round(sum(net), 4) AS revenue, round(sum(net * (1 + l_tax)), 4) AS charge FROM {LIVE} WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1")
def model_row_rule(t):
    """The rule's table is joined and filtered though the question does not name it."""
    user = User("ana", groups=("finance",), user_variables={"region": ["ASIA", "EUROPE"]})
    return trade(t).query(["segment"], ["revenue", "charge"], user=user)


@query("model_role_playing", f"SELECT n.n_name AS seller, l.n_name AS nation, count(*) AS lines FROM {LIVE} l LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation n ON s_nationkey = n.n_nationkey GROUP BY 1, 2")
def model_role_playing(t):
    return trade(t).query(["seller", "nation"], ["lines"], unsecured=True)


FACT_TOTALS = "SELECT r_name AS region, {m} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus <> 'P' GROUP BY 1"


@query("model_two_facts_formula", f"""SELECT region, revenue, order_total FROM (SELECT r_name AS region, round(sum(net), 4) AS revenue FROM {LIVE} GROUP BY 1)
    FULL JOIN ({FACT_TOTALS.format(m='round(sum(o_totalprice), 2) AS order_total')}) USING (region)""")
def model_two_facts_formula(t):
    """A formula of one fact does not concern the other."""
    return trade(t).query(["region"], ["revenue", "order_total"], unsecured=True)


@query("model_fact_filter", f"""SELECT region, lines, order_total FROM (SELECT r_name AS region, count(*) AS lines FROM {LIVE} WHERE l_quantity > 25 GROUP BY 1)
    FULL JOIN ({FACT_TOTALS.format(m='round(sum(o_totalprice), 2) AS order_total')}) USING (region)""")
def model_fact_filter(t):
    """A filter on one fact's own table leaves the other's rows alone."""
    return trade(t).query(["region"], ["lines", "order_total"], filters=[(("lineitem",), (), "l_quantity > 25")], unsecured=True)


@query("model_column_rule", f"SELECT c_mktsegment AS segment, round(sum(net), 4) AS revenue FROM {LIVE} WHERE r_name = 'ASIA' GROUP BY 1")
def model_column_rule(t):
    """A user without the group gets what is not restricted."""
    return trade(t).query(["segment"], ["revenue"], user=User("bo", user_variables={"region": ["ASIA"]}))


@query("model_row_rule_default", f"SELECT count(*) AS lines FROM {LIVE} WHERE false")
def model_row_rule_default(t):
    """A user without values for the rule counts no row."""
    return trade(t).query([], ["lines"], user=User("cy"))


_BY_NATION = f"SELECT r_name AS region, n_name AS nation, round(sum(net), 4) AS revenue FROM {LIVE} WHERE l_quantity > 10 GROUP BY 1, 2"
SMALL_LINES = [(("lineitem",), (), "l_quantity > 10")]


@query("model_levels", f"""WITH q AS ({_BY_NATION}), r AS (SELECT r_name AS region, round(sum(net), 4) AS whole FROM {LIVE} GROUP BY 1),
    c AS (SELECT region, nation, avg(v) AS per_segment FROM (SELECT r_name AS region, n_name AS nation, c_mktsegment, round(sum(net), 4) AS v FROM {LIVE} WHERE l_quantity > 10 GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT q.*, whole, round(per_segment, 6) AS per_segment, round(revenue / whole, 8) AS part FROM q JOIN r USING (region) JOIN c USING (region, nation)""")
def model_levels(t):
    """The region's revenue without the question's filter, the mean of the segments', and a share, in the model."""
    out = trade(t).query(["region", "nation"], ["revenue"], filters=SMALL_LINES, unsecured=True, stages=[
        G.Level("whole", "revenue", Grouping(minus=("nation",)), filtered=False),
        G.Level("per_segment", "revenue", Grouping(plus=("segment",)), again="AVG"),
        G.Computed("part", "round(revenue / whole, 8)"),
    ])
    return out.withColumn("per_segment", R("per_segment", 6))


@query("model_windows", f"""WITH q AS (SELECT r_name AS region, date_trunc('month', o_orderdate)::DATE AS order_month, count(*) AS lines FROM {LIVE} GROUP BY 1, 2)
    SELECT *, (sum(lines) OVER (PARTITION BY region ORDER BY order_month))::BIGINT AS so_far, (max(lines) OVER (PARTITION BY region ORDER BY order_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS peak,
    rank() OVER (PARTITION BY region ORDER BY lines DESC) AS place, rank() OVER (ORDER BY lines DESC) AS place_of_all, round(lines / sum(lines) OVER (PARTITION BY region), 8) AS share FROM q""")
def model_windows(t):
    out = trade(t).query(["region", "order_month"], ["lines"], unsecured=True, stages=[
        G.Running("so_far", "lines", ("order_month",), ("region",)), G.Running("peak", "lines", ("order_month",), ("region",), "MAX", (2, 0)),
        G.Rank("place", "lines", ("region",)), G.Rank("place_of_all", "lines"), G.Share("share", "lines", ("region",)),
    ])
    return out.withColumn("share", R("share", 8))


@query("model_members", f"""WITH q AS (SELECT n_name AS nation, c_mktsegment AS segment, count(*) AS lines FROM {LIVE} GROUP BY 1, 2), n AS (SELECT nation, sum(lines) AS s FROM q GROUP BY 1),
    top AS (SELECT nation FROM n ORDER BY s DESC, nation LIMIT 5) SELECT q.*, s > 2000 AS large FROM q JOIN n USING (nation) WHERE nation IN (SELECT nation FROM top)""")
def model_members(t):
    """The five nations with most lines, by segment, and whether a nation is a large one."""
    return trade(t).query(["nation", "segment"], ["lines"], unsecured=True, stages=[
        G.Members("nation", "lines", n=5), G.Members("nation", "lines", condition="lines > 2000", inside="large")])


@query("model_others", f"""WITH n AS (SELECT n_name AS nation, count(*) AS lines FROM {LIVE} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY lines DESC, nation) AS k FROM n)
    SELECT CASE WHEN k <= 4 THEN nation ELSE 'Others' END AS nation, sum(lines)::BIGINT AS lines FROM r GROUP BY 1""")
def model_others(t):
    return trade(t).query(["nation"], ["lines"], unsecured=True, stages=[G.Others("nation", "lines", 4)]).select("nation", "lines")


@query("model_from_rollup", f"""SELECT r_name AS region, date_trunc('year', o_orderdate)::DATE AS order_year, round(sum(net), 4) AS revenue, count(*) AS lines FROM {LIVE}
    WHERE r_name IN ('ASIA', 'EUROPE') AND c_mktsegment <> 'BUILDING' GROUP BY 1, 2""")
def model_from_rollup(t):
    """Years from a stored rollup of months, filtered, and under a row rule whose column the rollup was given."""
    m = trade(t)
    kept = m.rollup("months", ["nation", "segment", "order_month"], ["revenue", "lines"])
    path = fresh_path(t.spark, "rollup-months")
    kept.kept.frame.write.parquet(path)
    stored = M.Stored(kept.fact, M.replace(kept.kept, frame=t.spark.read.parquet(path)))
    user = User("ana", user_variables={"region": ["ASIA", "EUROPE"]})
    return m.query(["region", "order_year"], ["revenue", "lines"], filters=[(("customer",), (), "c_mktsegment <> 'BUILDING'")], user=user, rollups=[stored])


def two_ways(t) -> M.Model:
    """Nations by the customer and by the supplier of a line, as one table."""
    m = trade(t)
    joins = [j for j in m.joins if j.one != "seller_nation"] + [M.Join("supplier", "nation", [("s_nationkey", "n_nationkey")], "left")]
    return M.replace(m, joins=joins, tables=[x for x in m.tables if x.name != "seller_nation"], attributes=[a for a in m.attributes if a.name != "seller"],
                     filters=(), row_rules=(), column_rules=())


@query("model_join_path", """SELECT r_name AS region, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def model_join_path(t):
    """Regions of the suppliers: two ways lead to the nations, and the question names its own."""
    return two_ways(t).query(["region"], ["lines"], via={"nation": ["supplier"]}, unsecured=True)
