"""Row filters, column rules and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalogue.registry import query
from orrery.operators import joins as J, security as Y

c = F.col
R = F.round
ANA = Y.User("ana", groups=("BUILDING", "MACHINERY"), org="north", org_variables={"status": "P", "size_var": [1, 2]}, user_variables={"status": ["O", "F"]})
BY = "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE {w} GROUP BY 1"
by = lambda df: df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), R(F.sum("c_acctbal"), 2).alias("balance"))


@query("row_filter_groups", BY.format(w="c_mktsegment IN ('BUILDING', 'MACHINERY')"))
def row_filter_groups(t):
    return by(t.customer.filter(Y.row_filter_groups(c("c_mktsegment"), ANA)))


@query("row_filter_user", "SELECT role, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1")
def row_filter_user(t):
    return t.conversations.filter(Y.row_filter_user(c("role"), Y.User("user"))).groupBy("role").agg(F.count("*").alias("n"))


@query("row_filter_entitled", """SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_nationkey IN
    (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1""")
def row_filter_entitled(t):
    """Nations with three suppliers or more are open to the group 'trade'."""
    table = t.supplier.groupBy("s_nationkey").count().select(F.when(c("count") >= 3, "trade").otherwise("closed").alias("holder"), "s_nationkey")
    return by(Y.row_filter_entitled(t.customer, "c_nationkey", table, Y.User("bo", groups=("trade",)), "holder", "s_nationkey"))


@query("row_filter_variable", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1")
def row_filter_variable(t):
    """The user's own values go before the organisation's."""
    return t.orders.filter(Y.row_filter_variable(c("o_orderstatus"), ANA, "status")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("row_filter_or_admin", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def row_filter_or_admin(t):
    boss = Y.User("root", groups=("admins",))
    allowed = Y.row_filter_or_admin(Y.row_filter_variable(c("o_orderstatus"), boss, "status"), boss, ["admins"])
    return t.orders.filter(allowed).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("row_filter_joined", "SELECT o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 1")
def row_filter_joined(t):
    dims = [J.Dim(t.customer, [("o_custkey", "c_custkey")]), J.Dim(t.nation, [("c_nationkey", "n_nationkey")])]
    return Y.row_filter_joined(t.orders, dims, "n_regionkey", lambda k: k == 2).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


RULES = [("c_acctbal", "finance"), ("c_name", ""), ("c_mktsegment", "BUILDING")]


@query("column_rules", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def column_rules(t):
    return Y.column_rules(t.customer, RULES, ANA)


@query("column_rules_masked", "SELECT c_custkey, NULL::VARCHAR AS c_name, c_nationkey, NULL::DOUBLE AS c_acctbal, c_mktsegment FROM customer")
def column_rules_masked(t):
    return Y.column_rules(t.customer, RULES, ANA, mask=True)


# Rules of two organisations; nations are a table of their own and, under another name, the sellers'.
MANIFEST = [
    ("north", "customer", "c_name", ""), ("north", "customer", "c_acctbal", "BUILDING"), ("south", "customer", "c_acctbal", "finance"),
    ("north", "nation", "n_name", ""), ("", "sellers", "n_regionkey", "geo"),
]


def manifest(t):
    names = "org_name string, table_name string, column_name string, group_name string"
    return Y.rules_of(t.spark.createDataFrame(MANIFEST, names).collect())


@query("column_rules_by_table", """SELECT 'north' AS org, c_custkey, NULL::VARCHAR AS c_name, c_acctbal, NULL::VARCHAR AS n_name, n_regionkey, NULL::BIGINT AS seller_region, n_name AS seller FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'south', c_custkey, c_name, NULL, n_name, n_regionkey, NULL, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def column_rules_by_table(t):
    """Two tables with the same columns under different rules, for users of two organisations."""
    def seen(user):
        part = lambda df, name: Y.column_rules(df, manifest(t), user, mask=True, table=name)
        customer, nation, sellers = part(t.customer, "customer"), part(t.nation, "nation"), part(t.nation, "sellers")
        other = sellers.select(c("n_nationkey").alias("seller_key"), c("n_regionkey").alias("seller_region"), c("n_name").alias("seller"))
        met = J.star_join(customer, J.Dim(nation, [("c_nationkey", "n_nationkey")]), J.Dim(other, [("c_nationkey", "seller_key")]))
        return met.select(F.lit(user.org).alias("org"), "c_custkey", "c_name", "c_acctbal", "n_name", "n_regionkey", "seller_region", "seller")

    return seen(ANA).unionByName(seen(Y.User("bo", groups=("BUILDING",), org="south")))


@query("mask_column", "SELECT c_custkey, sha256(c_name) AS hashed, repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) AS tail, regexp_replace(c_name, '[0-9]', '#', 'g') AS shape FROM customer")
def mask_column(t):
    return t.customer.select("c_custkey", Y.mask_column(c("c_name"), "hash").alias("hashed"), Y.mask_column(c("c_name"), "last4").alias("tail"), Y.mask_column(c("c_name"), "digits").alias("shape"))
