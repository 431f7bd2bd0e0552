"""Level of detail: values of other groupings and filter scopes beside the query's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalogue.registry import query
from orrery.operators import joins as J, levels as V, lod as L
from orrery.operators.rollups import Measure

c = F.col
R = F.round


def rows(t):
    """Orders with customer, nation and region: the model-filtered rows (no cancelled status here)."""
    return J.star_join(
        t.orders, J.Dim(t.customer, [("o_custkey", "c_custkey")]), J.Dim(t.nation, [("c_nationkey", "n_nationkey")]),
        J.Dim(t.region, [("n_regionkey", "r_regionkey")]),
    ).filter(c("o_orderpriority") != "5-LOW")


BASE = """m AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE o_orderpriority <> '5-LOW')"""
SEL = "o_orderstatus = 'O' AND c_mktsegment IN ('BUILDING', 'MACHINERY')"
MAIN = f"q AS (SELECT r_name, n_name, round(sum(o_totalprice), 2) AS sales FROM m WHERE {SEL} GROUP BY 1, 2)"


def ctx(t, dims=("r_name", "n_name")):
    return L.Context(rows(t), dims, {
        "o_orderstatus": c("o_orderstatus") == "O", "c_mktsegment": c("c_mktsegment").isin("BUILDING", "MACHINERY"),
    })


def total(name, **more):
    """The rounded sum of prices as a value of a question."""
    return V.Value(Measure(name, "SUM", "o_totalprice"), then=lambda x: R(x, 2), **more)


def beside(name: str, grouping, scope, sub: str, on: str):
    """Record a query that puts one LOD value beside sales by region and nation."""
    join = f"LEFT JOIN ({sub}) s ON {on}" if on else f"CROSS JOIN ({sub}) s"

    def run(t):
        return V.beside(ctx(t), [total("sales"), total("lod", grouping=grouping(), scope=scope())])

    query(name, f"WITH {BASE}, {MAIN} SELECT q.r_name, q.n_name, q.sales, s.lod FROM q {join}")(run)


_SUM = "round(sum(o_totalprice), 2) AS lod"
_REGION = lambda: L.Grouping(fixed=("r_name",))
ON_R = "q.r_name = s.r_name"
beside("lod_fixed", _REGION, L.Scope, f"SELECT r_name, {_SUM} FROM m WHERE {SEL} GROUP BY 1", ON_R)
beside("lod_fixed_unfiltered", _REGION, lambda: L.Scope(inherit=False), f"SELECT r_name, {_SUM} FROM m GROUP BY 1", ON_R)
beside("lod_grand_total", lambda: L.Grouping(fixed=()), L.Scope, f"SELECT {_SUM} FROM m WHERE {SEL}", "")
beside("lod_exclude", lambda: L.Grouping(minus=("n_name",)), L.Scope, f"SELECT r_name, {_SUM} FROM m WHERE {SEL} GROUP BY 1", ON_R)
beside("lod_only_if_present", lambda: L.Grouping(only=("n_name", "c_mktsegment")), L.Scope, f"SELECT n_name, {_SUM} FROM m WHERE {SEL} GROUP BY 1", "q.n_name = s.n_name")
beside("lod_hard_filter", _REGION, lambda: L.Scope(inherit=False, plus={"o_orderstatus": c("o_orderstatus") == "F"}),
       f"SELECT r_name, {_SUM} FROM m WHERE o_orderstatus = 'F' GROUP BY 1", ON_R)
beside("lod_add_filter", _REGION, lambda: L.Scope(plus={"o_totalprice": c("o_totalprice") > 200000}),
       f"SELECT r_name, {_SUM} FROM m WHERE {SEL} AND o_totalprice > 200000 GROUP BY 1", ON_R)
beside("lod_minus_filter", _REGION, lambda: L.Scope(minus=("c_mktsegment",)),
       f"SELECT r_name, {_SUM} FROM m WHERE o_orderstatus = 'O' GROUP BY 1", ON_R)
beside("lod_only_filter", _REGION, lambda: L.Scope(only=("c_mktsegment",)),
       f"SELECT r_name, {_SUM} FROM m WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1", ON_R)


@query("lod_include", f"""WITH {BASE}, {MAIN} SELECT q.*, s.lod FROM q JOIN (SELECT r_name, n_name, round(avg(v), 4) AS lod
    FROM (SELECT r_name, n_name, o_custkey, sum(o_totalprice) AS v FROM m WHERE {SEL} GROUP BY 1, 2, 3) GROUP BY 1, 2) s ON q.r_name = s.r_name AND q.n_name = s.n_name""")
def lod_include(t):
    sums = V.Value(Measure("lod", "SUM", "o_totalprice"), L.Grouping(plus=("o_custkey",)), again=F.avg, then=lambda x: R(x, 4))
    return V.beside(ctx(t), [total("sales"), sums])


@query("remove_filter_context", f"WITH {BASE}, {MAIN} SELECT q.*, s.lod FROM q LEFT JOIN (SELECT r_name, {_SUM} FROM m WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1) s ON {ON_R}")
def remove_filter_context(t):
    free = V.without(Measure("lod", "SUM", "o_totalprice"), ["n_name", "o_orderstatus"], then=lambda x: R(x, 2))
    return V.beside(ctx(t), [total("sales"), free])


@query("lod_unique_count", f"""WITH {BASE}, q AS (SELECT r_name, n_name, count(DISTINCT o_custkey) AS buyers, round(sum(o_totalprice), 2) AS sales FROM m WHERE {SEL} GROUP BY 1, 2)
    SELECT q.*, s.lod, a.average FROM q LEFT JOIN (SELECT r_name, count(DISTINCT o_custkey) AS lod FROM m WHERE o_orderstatus = 'O' GROUP BY 1) s ON {ON_R}
    LEFT JOIN (SELECT r_name, round(avg(o_totalprice), 4) AS average FROM m GROUP BY 1) a ON q.r_name = a.r_name""")
def lod_unique_count(t):
    """Distinct counts and averages of several groupings and scopes from one pass."""
    region = L.Grouping(fixed=("r_name",))
    return V.beside(ctx(t), [
        V.Value(Measure("buyers", "UNIQUE_COUNT", "o_custkey")), total("sales"),
        V.Value(Measure("lod", "UNIQUE_COUNT", "o_custkey"), region, L.Scope(minus=("c_mktsegment",))),
        V.Value(Measure("average", "AVG", "o_totalprice"), region, L.Scope(inherit=False), then=lambda x: R(x, 4)),
    ])


@query("set_override", f"""WITH {BASE}, {MAIN} SELECT q.r_name, q.n_name, q.sales, a.v AS replaced, b.v AS added, d.v AS removed, e.v AS everything FROM q
    LEFT JOIN (SELECT r_name, n_name, round(sum(o_totalprice), 2) AS v FROM m WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus = 'F' GROUP BY 1, 2) a ON a.n_name = q.n_name
    LEFT JOIN (SELECT r_name, n_name, round(sum(o_totalprice), 2) AS v FROM m WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND o_orderstatus = 'O' GROUP BY 1, 2) b ON b.n_name = q.n_name
    LEFT JOIN (SELECT r_name, n_name, round(sum(o_totalprice), 2) AS v FROM m WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O' GROUP BY 1, 2) d ON d.n_name = q.n_name
    LEFT JOIN (SELECT r_name, n_name, round(sum(o_totalprice), 2) AS v FROM m GROUP BY 1, 2) e ON e.n_name = q.n_name""")
def set_override(t):
    x = ctx(t)
    again = lambda name, **edit: V.reselected(x, Measure(name, "SUM", "o_totalprice"), then=lambda v: R(v, 2), **edit)
    return V.beside(x, [
        total("sales"), again("replaced", replace={"o_orderstatus": ["F"]}), again("added", add={"c_mktsegment": ["FURNITURE"]}),
        again("removed", remove={"c_mktsegment": ["MACHINERY"]}), again("everything", everything=True),
    ])


for _name, _f, _sql in (
    ("group_sum", lambda: R(F.sum("p_retailprice"), 2), "round(sum(p_retailprice), 2)"),
    ("group_average", lambda: R(F.avg("p_retailprice"), 4), "round(avg(p_retailprice), 4)"),
    ("group_count", lambda: F.count("p_retailprice"), "count(p_retailprice)"),
    ("group_max", lambda: F.max("p_retailprice"), "max(p_retailprice)"),
    ("group_min", lambda: F.min("p_retailprice"), "min(p_retailprice)"),
    ("group_unique_count", lambda: F.count_distinct("p_size"), "count(DISTINCT p_size)"),
    ("group_stddev", lambda: R(F.stddev_samp("p_retailprice"), 6), "round(stddev_samp(p_retailprice), 6)"),
    ("group_variance", lambda: R(F.var_samp("p_retailprice"), 4), "round(var_samp(p_retailprice), 4)"),
):
    query(_name, f"SELECT p_partkey, p.p_brand, v FROM part p JOIN (SELECT p_brand, {_sql} AS v FROM part GROUP BY 1) g ON p.p_brand = g.p_brand")(
        lambda t, f=_f: L.group_value(t.part.select("p_partkey", "p_brand", "p_retailprice", "p_size"), ["p_brand"], f(), "v").select("p_partkey", "p_brand", "v"))


@query("percent_of_total", "SELECT c_mktsegment, round(s / sum(s) OVER (), 8) AS share FROM (SELECT c_mktsegment, sum(c_acctbal) AS s FROM customer GROUP BY 1)")
def percent_of_total(t):
    by = t.customer.groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("s"))
    return L.percent_of_total(by, "s", "share").select("c_mktsegment", R("share", 8).alias("share"))


@query("percent_of_group", "SELECT p_type, p_brand, round(s / sum(s) OVER (PARTITION BY p_type), 8) AS share FROM (SELECT p_type, p_brand, sum(p_retailprice) AS s FROM part GROUP BY 1, 2)")
def percent_of_group(t):
    by = t.part.groupBy("p_type", "p_brand").agg(F.sum("p_retailprice").alias("s"))
    return L.percent_of_group(by, "s", ["p_type"], "share").select("p_type", "p_brand", R("share", 8).alias("share"))


@query("relative_to_max_date", "SELECT days_before_last // 30 AS age, count(*) AS n FROM (SELECT date_diff('day', o_orderdate, max(o_orderdate) OVER ()) AS days_before_last FROM orders) GROUP BY 1")
def relative_to_max_date(t):
    aged = L.relative_to_max_date(t.orders, "o_orderdate")
    return aged.groupBy(F.floor(c("days_before_last") / 30).alias("age")).agg(F.count("*").alias("n"))
