"""The semantic model: pruning, refusals, security, and what the plans read."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from orrery.catalogue.models import trade
from orrery.operators import security as Y
from orrery.operators.joins import Dim
from orrery.plans import model as M


def scanned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_left_joins_are_pruned_and_inner_ones_kept(t):
    p = scanned(trade(t).query(["segment"], ["revenue"], unsecured=True))
    assert "part.parquet" not in p and "supplier.parquet" not in p
    assert "region.parquet" in p and "nation.parquet" in p


def test_dimension_only_reads_no_fact(t):
    p = scanned(trade(t).query(["nation", "region"], unsecured=True))
    assert "lineitem.parquet" not in p and "orders.parquet" not in p


def test_filters_and_columns_reach_the_scan(t):
    t.spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    p = scanned(trade(t).query(["nation"], ["lines"], filters=[(("orders",), (), "o_totalprice >= {least}")], parameters={"least": 300000.0}, unsecured=True))
    assert "GreaterThanOrEqual(o_totalprice,300000.0)" in p
    assert "l_comment" not in p and "l_extendedprice" not in p


def test_unreachable_dimension_is_refused(t):
    with pytest.raises(ValueError, match="without multiplying"):
        trade(t).query(["brand"], ["order_total"], unsecured=True)


def test_formula_circle_and_depth(t):
    base = trade(t)
    loop = [M.Formula("a", ("orders",), "b + 1", uses=("b",)), M.Formula("b", ("orders",), "a + 1", uses=("a",))]
    m = M.Model(base.tables, base.joins, base.attributes, [M.Measure("x", "orders", "sum(a)", uses=("a",))], loop)
    with pytest.raises(ValueError, match="circle"):
        m.query([], ["x"])
    chain = [M.Formula(f"f{i}", ("orders",), f"f{i + 1} + 1", uses=(f"f{i + 1}",)) for i in range(3)] + [M.Formula("f3", ("orders",), "o_totalprice")]
    deep = M.Model(base.tables, base.joins, base.attributes, [M.Measure("x", "orders", "sum(f0)", uses=("f0",))], chain)
    with pytest.raises(ValueError, match="deeper"):
        deep.query([], ["x"])


def test_closed_columns_are_refused(t):
    with pytest.raises(PermissionError):
        trade(t).query(["segment"], ["charge"], user=Y.User("eve"))


def test_row_rule_without_values_lets_nothing_through(t):
    assert trade(t).query(["segment"], ["revenue"], user=Y.User("eve", groups=("finance",))).count() == 0


def test_date_constraint_needs_a_reference(t):
    base = trade(t)
    m = M.Model(base.tables, base.joins, base.attributes, base.measures, base.formulas, constraints={"orders": [[("o_orderdate", 1, "YEAR")]]})
    with pytest.raises(ValueError, match="reference date"):
        m.query(["segment"], ["orders"])
    ref = F.lit("1999-12-31").cast("date")
    assert m.query([], ["orders"], ref=ref).first().orders == t.orders.filter("o_orderdate between date '1998-12-31' and date '1999-12-31'").count()


def test_joined_row_filter_fails_closed(t):
    assert Y.row_filter_joined(t.orders, [Dim(t.customer, [("o_custkey", "c_custkey")])], "no_such_column", lambda c: c == 1).count() == 0


def test_empty_group_means_nobody():
    rules = [("cost", ""), ("price", "a")]
    assert Y.allowed_columns(["id", "cost", "price"], rules, ["a"]) == ["id", "price"]
    assert Y.allowed_columns(["id", "cost", "price"], rules, []) == ["id"]


def test_most_specific_variable_wins():
    u = Y.User("u", org_variables={"v": 1, "w": 2}, user_variables={"v": [3, 4]})
    assert u.variable("v") == [3, 4] and u.variable("w") == [2] and u.variable("x") == []


def test_rules_fail_closed(t):
    m, eve = trade(t), Y.User("eve", user_variables={"region": ["ASIA"]})
    with pytest.raises(PermissionError):
        m.query(["segment"], ["revenue"])
    for question in (
        dict(measures=["revenue"], filters=[((), ("charge",), "charge > 10")]),
        dict(measures=["revenue"], filters=[(("lineitem",), (), "charge > 10")]),
        dict(measures=["revenue"], having="max(charge) > 1"),
    ):
        with pytest.raises(PermissionError):
            m.query(["segment"], user=eve, **question)
    leak = dataclasses.replace(m, measures=[*m.measures, M.Measure("other", "lineitem", "max(charge)", uses=("charge",))],
                               formulas=[*m.formulas, M.Formula("twice", ("lineitem",), "2 * charge", uses=("charge",))])
    with pytest.raises(PermissionError):
        leak.query(["segment"], ["other"], user=eve)
    with pytest.raises(PermissionError):
        leak.query(["segment"], ["lines"], filters=[((), ("twice",), "twice > 1")], user=eve)
    assert leak.query(["segment"], ["other"], user=dataclasses.replace(eve, groups=("finance",))).count() > 0


def test_filter_no_fact_reaches(t):
    with pytest.raises(ValueError, match="no fact"):
        trade(t).query(["region"], ["order_total"], filters=[(("part",), (), "p_size > 1")], unsecured=True)


def test_two_ways_to_a_table(t):
    m = trade(t)
    two = dataclasses.replace(m, joins=[*m.joins, M.Join("supplier", "nation", [("s_nationkey", "n_nationkey")])])
    with pytest.raises(ValueError, match="more than one way"):
        two.query(["nation"], ["lines"], unsecured=True)


def two_nations(t, rules):
    """Nations twice, once as the sellers' under a prefix, with rules of their own."""
    return M.Model(
        tables=[M.Table("customer", t.customer), M.Table("nation", t.nation), M.Table("sellers", t.nation, prefix="seller_")],
        joins=[M.Join("customer", "nation", [("c_nationkey", "n_nationkey")]), M.Join("customer", "sellers", [("c_nationkey", "seller_n_nationkey")])],
        attributes=[M.Attribute("nation", "nation", "n_name"), M.Attribute("seller", "sellers", "seller_n_name"), M.Attribute("label", "sellers", "upper(SELLER_N_NAME)"),
                    M.Attribute("odd", "nation", "`no such column`")],
        measures=[M.Measure("n", "customer", "count(*)"), M.Measure("named", "customer", "count(tag)", uses=("tag",))],
        formulas=[M.Formula("tag", ("sellers",), "concat('x', seller_n_name)")],
        column_rules=rules,
    )


def test_rules_by_organisation_and_table(t):
    rules = Y.rules_of([
        {"ORG_NAME": "north", "table_name": "sellers", "column_name": "N_NAME", "group_name": ""},
        {"org_name": "south", "table_name": "nation", "column_name": "n_name", "group_name": "geo"},
    ])
    m = two_nations(t, rules)
    north, south, geo = Y.User("a", org="north"), Y.User("b", org="south"), Y.User("c", groups=("geo",), org="south")
    assert m.query(["nation"], ["n"], user=north).count() > 0
    for closed in ("seller", "label"):
        with pytest.raises(PermissionError, match="seller_n_name"):
            m.query([closed], ["n"], user=north)
    with pytest.raises(PermissionError):  # a formula that is made of the column
        m.query(["nation"], ["named"], user=north)
    with pytest.raises(PermissionError):
        m.query(["nation"], ["n"], user=south)
    assert m.query(["seller"], ["named"], user=south).count() > 0
    assert m.query(["nation"], ["n"], user=geo).count() > 0
    with pytest.raises(PermissionError, match="resolved"):
        m.query(["odd"], ["n"], user=geo)


def test_rules_that_name_nothing_are_refused(t):
    with pytest.raises(ValueError, match="does not have"):
        two_nations(t, [Y.ColumnRule("gone", "", "nation")]).query(["nation"], ["n"], user=Y.User("a"))
    with pytest.raises(ValueError, match="must name"):
        Y.rules_of([{"table_name": "nation", "column_name": " ", "group_name": "geo"}])
    with pytest.raises(ValueError, match="no columns"):
        Y.column_rules(t.nation, [Y.ColumnRule("gone", "", "nation")], Y.User("a"), table="nation")
    seen = Y.column_rules(t.nation, [Y.ColumnRule("N_NAME", "", "Nation"), Y.ColumnRule("n_regionkey", "", "other")], Y.User("a"), table="nation")
    assert seen.columns == ["n_nationkey", "n_regionkey", *[c for c in t.nation.columns if c not in ("n_nationkey", "n_name", "n_regionkey")]]


def test_ways_must_be_named(t):
    from orrery.catalogue.models import two_ways

    m = two_ways(t)
    assert m.query(["segment"], ["orders"], unsecured=True).count() == 5  # orders reach nations by customers alone
    with pytest.raises(ValueError, match="more than one way"):
        m.query(["region"], ["lines"], unsecured=True)
    with pytest.raises(ValueError, match="no way"):
        m.query(["region"], ["lines"], via={"nation": ["part"]}, unsecured=True)
    by = {w: {r.region: r.lines for r in m.query(["region"], ["lines"], via={"nation": [w]}, unsecured=True).collect()} for w in ("customer", "supplier")}
    assert by["customer"] != by["supplier"] and sum(by["customer"].values()) == sum(by["supplier"].values()) == t.lineitem.count()


def test_stages_keep_the_rules(t):
    from orrery.operators.lod import Grouping
    from orrery.plans import stages as G

    user = Y.User("ana", user_variables={"region": ["ASIA"]})
    ask = lambda *s, **k: trade(t).query(["nation"], ["lines"], user=user, stages=s, **k)
    rows = ask(G.Level("all", "lines", Grouping(fixed=()), filtered=False), G.Share("share", "lines")).collect()
    assert len({r["all"] for r in rows}) == 1 and rows[0]["all"] == sum(r.lines for r in rows)
    assert sum(r.share for r in rows) == pytest.approx(1)
    with pytest.raises(PermissionError):  # a stage reads no measure that the question could not
        ask(G.Level("closed", "charge", Grouping()))
    with pytest.raises(ValueError, match="again"):
        ask(G.Level("fine", "lines", Grouping(plus=("segment",))))
    with pytest.raises(ValueError, match="one attribute"):
        trade(t).query(["nation", "segment"], ["lines"], user=user, stages=[G.Others("nation", "lines", 2)])
    kept = ask(G.Members("nation", "lines", n=2), having="lines > 0").collect()
    assert {r.nation for r in kept} == {r.nation for r in sorted(rows, key=lambda r: (-r.lines, r.nation))[:2]}
    assert {r.nation for r in ask(G.Members("nation", "lines", n=1, top=False)).collect()} == {min(rows, key=lambda r: (r.lines, r.nation)).nation}


def test_rollups_answer_only_what_they_hold(t):
    m = trade(t)
    kept = m.rollup("months", ["nation", "order_month"], ["revenue", "lines"])
    assert set(kept.kept.dims) == {"nation", "region"}  # the row rule's column came along
    empty = M.Stored(kept.fact, M.replace(kept.kept, frame=kept.kept.frame.limit(0)))
    ask = lambda atts, mes, **k: m.query(atts, mes, unsecured=True, rollups=[empty], **k).count()
    assert ask(["nation", "order_year"], ["lines"]) == 0  # answered by the rollup, which is empty here
    assert ask(["segment"], ["lines"]) > 0 and ask(["nation"], ["charge"]) > 0  # a column and a measure it lacks
    assert ask(["order_month", "order_year"], ["lines"]) > 0  # two buckets of one date
    assert ask(["nation"], ["lines"], filters=[(("orders",), (), "o_totalprice > 10")]) > 0  # a filter on what it lacks
    assert ask(["nation"], ["lines"], filters=[(("region",), (), "r_name = 'ASIA'")]) == 0
    silent = M.replace(m, row_rules=[M.RowRule("region", m.row_rules[0].predicate)])
    with pytest.raises(ValueError, match="secured"):
        silent.rollup("months", ["nation"], ["lines"])
    lost = M.replace(m, row_rules=[M.RowRule("region", m.row_rules[0].predicate, ("r_regionkey",))])
    with pytest.raises(ValueError, match="no attribute holds"):
        lost.rollup("months", ["nation"], ["lines"])
    with pytest.raises(ValueError, match="declared"):
        m.rollup("x", ["nation"], ["charge"])
    user = Y.User("ana", user_variables={"region": ["ASIA"]})
    full = lambda **k: sorted(tuple(r) for r in m.query(["nation", "order_year"], ["revenue", "lines"], user=user, **k).collect())
    assert full(rollups=[kept]) == full()
