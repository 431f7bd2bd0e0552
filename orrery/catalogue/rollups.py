"""Rollups: components, answering, parity, profiling, and advice from a log made of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalogue.joins import NET, STAR, net, star
from orrery.catalogue.registry import query
from orrery.functions import dates as D
from orrery.operators import advice as A, joins as J, rollups as P, security as Y, timeintel as T
from orrery.session import fresh_path
from orrery.sources.sinks import write_rollup

c = F.col
R = F.round

MEASURES = [
    P.Measure("revenue", "SUM", "net"), P.Measure("lines", "COUNT", "l_orderkey"), P.Measure("avg_qty", "AVG", "l_quantity"),
    P.Measure("unit_price", "RATIO", "net", per="l_quantity"), P.Measure("first_ship", "MIN", "l_shipdate"), P.Measure("biggest", "MAX", "l_quantity"),
]


def rows(t):
    return star(t).withColumn("net", net()).select(
        "r_name", "n_name", "c_mktsegment", "o_orderstatus", "o_custkey", "o_orderdate", "l_orderkey", "l_quantity", "l_shipdate", "net")


def stored(t, dims=("r_name", "n_name", "c_mktsegment"), measures=MEASURES):
    """A rollup by month, written in partitions of a year and read back."""
    path = fresh_path(t.spark, "rollup")
    roll = P.build_rollup(rows(t), list(dims), {"o_orderdate": "MONTHLY"}, measures)
    write_rollup(roll.withColumn("part_year", F.year("o_orderdate")), path, ["part_year"])
    return t.spark.read.parquet(path)


TOP = f"SELECT *, {NET} AS net FROM {STAR.format(j='')}"
tidy = lambda df: df.withColumns({k: R(k, d) for k, d in (("revenue", 4), ("avg_qty", 6), ("unit_price", 4)) if k in df.columns})
FIN = "round(sum(net), 4) AS revenue, count(l_orderkey) AS lines, round(avg(l_quantity), 6) AS avg_qty, round(sum(net) / sum(l_quantity), 4) AS unit_price, min(l_shipdate) AS first_ship, max(l_quantity) AS biggest"


@query("build_rollup", f"SELECT r_name, n_name, date_trunc('month', o_orderdate)::DATE AS o_orderdate, round(sum(net), 4) AS revenue_sum, count(l_orderkey) AS lines_cnt, sum(l_quantity) AS avg_qty_sum, count(l_quantity) AS avg_qty_cnt FROM ({TOP}) GROUP BY 1, 2, 3")
def build_rollup(t):
    return P.build_rollup(rows(t), ["r_name", "n_name"], {"o_orderdate": "MONTHLY"}, MEASURES[:3]).withColumn("revenue_sum", R("revenue_sum", 4))


@query("decompose_measure", f"SELECT c_mktsegment, {FIN} FROM ({TOP}) GROUP BY 1")
def decompose_measure(t):
    """Every kind of measure, from components stored at a finer grain."""
    return tidy(P.reaggregate(P.build_rollup(rows(t), ["c_mktsegment", "n_name"], {"o_orderdate": "DAILY"}, MEASURES), ["c_mktsegment"], {}, MEASURES))


@query("reaggregate_rollup", f"SELECT r_name, date_trunc('quarter', o_orderdate)::DATE AS o_orderdate, {FIN} FROM ({TOP}) GROUP BY 1, 2")
def reaggregate_rollup(t):
    return tidy(P.reaggregate(stored(t), ["r_name"], {"o_orderdate": "QUARTERLY"}, MEASURES))


@query("reaggregate_unique_count", f"SELECT r_name, count(DISTINCT c_mktsegment) AS segments FROM ({TOP}) GROUP BY 1")
def reaggregate_unique_count(t):
    m = [P.Measure("segments", "UNIQUE_COUNT", "c_mktsegment")]
    return P.reaggregate(stored(t), ["r_name"], {}, m)


@query("route_to_rollup", f"SELECT r_name, date_trunc('year', o_orderdate)::DATE AS o_orderdate, round(sum(net), 4) AS revenue, count(l_orderkey) AS lines FROM ({TOP}) WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2")
def route_to_rollup(t):
    """The smallest rollup that covers the question answers it."""
    names = tuple(m.name for m in MEASURES)
    wide = P.Rollup("wide", stored(t), ("r_name", "n_name", "c_mktsegment"), {"o_orderdate": "MONTHLY"}, names, 9000)
    narrow = P.Rollup("narrow", stored(t, ("r_name",)), ("r_name",), {"o_orderdate": "MONTHLY"}, names, 400)
    ask = P.Request(("r_name",), {"o_orderdate": "YEARLY"}, tuple(MEASURES[:2]), {"c_mktsegment": c("c_mktsegment") == "BUILDING"})
    return tidy(P.answer(ask, [narrow, wide], rows(t)))


@query("rollup_parity", f"SELECT r_name, count(l_orderkey)::DOUBLE AS lines_rollup, count(l_orderkey)::DOUBLE AS lines_base, max(l_quantity) AS biggest_rollup, max(l_quantity) AS biggest_base, true AS agrees FROM ({TOP}) GROUP BY 1")
def rollup_parity(t):
    few = [MEASURES[1], MEASURES[5]]
    return P.rollup_parity(stored(t, measures=few), rows(t), ["r_name"], few)


@query("distinct_sketch_component", f"SELECT r_name, count(DISTINCT l_orderkey) AS orders, true AS within FROM ({TOP}) GROUP BY 1")
def distinct_sketch_component(t):
    """A stored sketch, merged, beside the exact count: is it within 3 %?"""
    near = P.sketch_count(P.sketch_rollup(rows(t), ["r_name", "n_name"], "l_orderkey", to="near"), ["r_name"], "near", sketch="near")
    both = rows(t).groupBy("r_name").agg(F.count_distinct("l_orderkey").alias("orders")).join(near, "r_name")
    return both.select("r_name", "orders", (F.abs(c("near") - c("orders")) <= 0.03 * c("orders")).alias("within"))


@query("snapshot_rollup", """WITH b AS (SELECT c_mktsegment, o_orderdate::DATE AS day, date_trunc('month', o_orderdate)::DATE AS period_start, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT b.c_mktsegment, b.period_start, round(sum(o_totalprice), 2) AS v FROM b JOIN (SELECT c_mktsegment, period_start, max(day) AS d FROM b GROUP BY 1, 2) e
          ON b.c_mktsegment = e.c_mktsegment AND b.period_start = e.period_start AND b.day = e.d GROUP BY 1, 2)
    SELECT c_mktsegment, date_trunc('year', period_start)::DATE AS year_start, arg_max(v, period_start) AS balance FROM s GROUP BY 1, 2""")
def snapshot_rollup(t):
    """Month-end balances are stored; year-end ones are read from them."""
    days = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("c_mktsegment", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    path = fresh_path(t.spark, "snapshots")
    snap = T.snapshot_period_end(days, ["c_mktsegment"], "day", "MONTHLY", "o_totalprice", "v").withColumn("v", R("v", 2))
    write_rollup(snap.withColumn("part_year", F.year("period_start")), path, ["part_year"])
    kept = t.spark.read.parquet(path).withColumn("year_start", D.date_bucket(c("period_start"), "YEARLY"))
    return T.last_value_semi(kept, ["c_mktsegment", "year_start"], "period_start", "v", "balance")


@query("rollup_secured", f"SELECT r_name, round(sum(net), 4) AS revenue FROM ({TOP}) WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') GROUP BY 1")
def rollup_secured(t):
    """The row filter's column joins the grain, and the same filter is applied on reading."""
    user = Y.User("ana", groups=("BUILDING", "HOUSEHOLD"))
    base = rows(t)
    dims = Y.secured_dims(["r_name"], ["c_mktsegment"], base.columns)
    few = [MEASURES[0]]
    roll = P.build_rollup(base, dims, {"o_orderdate": "MONTHLY"}, few)
    return tidy(P.reaggregate(roll.filter(Y.row_filter_groups(c("c_mktsegment"), user)), ["r_name"], {}, few))


_G = {"region": "r_name", "region_segment": "r_name, c_mktsegment", "customer": "o_custkey"}


@query("profile_grains", " UNION ALL ".join(
    f"SELECT '{n}' AS grain, (SELECT count(*) FROM (SELECT DISTINCT {k} FROM ({TOP}))) AS agg_rows, (SELECT count(*) FROM lineitem) AS base_rows, round((SELECT count(*) FROM lineitem) / (SELECT count(*) FROM (SELECT DISTINCT {k} FROM ({TOP})))::DOUBLE, 1) AS compression, false AS suspect_base"
    for n, k in _G.items()))
def profile_grains(t):
    return P.profile_grains(rows(t), {n: k.split(", ") for n, k in _G.items()}, exact=True)


@query("profile_grains_sketch", " UNION ALL ".join(
    f"SELECT '{n}' AS grain, (SELECT count(*) FROM (SELECT DISTINCT {k} FROM ({TOP}))) AS agg_rows, (SELECT count(*) FROM lineitem) AS base_rows, true AS within"
    for n, k in _G.items()))
def profile_grains_sketch(t):
    """One scan with sketches beside the exact counts: are they within 6 %?"""
    grains = {n: k.split(", ") for n, k in _G.items()}
    near = P.profile_grains(rows(t), grains).select("grain", c("agg_rows").alias("_near"))
    both = P.profile_grains(rows(t), grains, exact=True).join(near, "grain")
    return both.select("grain", "agg_rows", "base_rows", (F.abs(c("_near") - c("agg_rows")) <= 0.06 * c("agg_rows")).alias("within"))


# --- advice: each event stands for one saved question --------------------------------------------
_K = "json_extract_string(props, '$.k')::BIGINT"
LOG = f"""log AS (SELECT CASE event_type WHEN 'view' THEN ['region'] WHEN 'click' THEN ['nation', 'region'] WHEN 'purchase' THEN ['nation', 'segment'] WHEN 'signup' THEN ['status'] ELSE [] END AS dimensions,
    CASE WHEN value > 20 THEN 'order_date' END AS date_column, CASE WHEN value > 20 THEN CASE WHEN {_K} < 50 THEN 'MONTHLY' ELSE 'QUARTERLY' END END AS bucket,
    CASE WHEN {_K} % 10 = 0 THEN ['buyers', 'revenue'] ELSE ['revenue'] END AS measures, CASE WHEN {_K} > 80 THEN ['status'] ELSE [] END AS filter_columns FROM events)"""
SHAPE_KEYS = ["dimensions", "date_column", "bucket", "measures", "filter_columns"]


def log(t):
    names = lambda *n: F.array(*[F.lit(x) for x in n]) if n else F.array().cast("array<string>")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind, dated = c("event_type"), c("value") > 20
    return t.events.select(
        F.when(kind == "view", names("region")).when(kind == "click", names("nation", "region")).when(kind == "purchase", names("nation", "segment"))
        .when(kind == "signup", names("status")).otherwise(names()).alias("dimensions"),
        F.when(dated, "order_date").alias("date_column"),
        F.when(dated, F.when(k < 50, "MONTHLY").otherwise("QUARTERLY")).alias("bucket"),
        F.when(k % 10 == 0, names("buyers", "revenue")).otherwise(names("revenue")).alias("measures"),
        F.when(k > 80, names("status")).otherwise(names()).alias("filter_columns"))


PLANS = [P.stored(P.Measure("revenue", "SUM", "net")), P.stored(P.Measure("buyers", "UNIQUE_COUNT", "customer"))]
_ID = "concat_ws('|', array_to_string(dimensions, '+'), coalesce(date_column, '-'), coalesce(bucket, '-'), array_to_string(measures, '+'), array_to_string(filter_columns, '+'))"
SHAPES = f"shapes AS (SELECT {_ID} AS shape_id, dimensions, date_column, bucket, measures, filter_columns, count(*)::DOUBLE AS weight FROM log GROUP BY ALL)"
shapes = lambda t: A.query_shapes(log(t), SHAPE_KEYS)


@query("query_shapes", f"WITH {LOG}, {SHAPES} SELECT shape_id, weight FROM shapes")
def query_shapes(t):
    return shapes(t).select("shape_id", "weight")


def candidates(t):
    """Four grains with their sizes taken from the data."""
    listed = [("region_month", ["region"], "order_date", "MONTHLY"), ("nation_region", ["nation", "region"], None, None),
              ("wide_month", ["nation", "region", "segment", "status"], "order_date", "MONTHLY"), ("status_quarter", ["status"], "order_date", "QUARTERLY")]
    f = t.spark.createDataFrame(listed, "rollup_id string, dimensions array<string>, date_column string, bucket string")
    r = rows(t)
    size = P.profile_grains(r, {
        "region_month": ["r_name", D.date_bucket(c("o_orderdate"), "MONTHLY")], "nation_region": ["n_name", "r_name"],
        "wide_month": ["n_name", "r_name", "c_mktsegment", "o_orderstatus", D.date_bucket(c("o_orderdate"), "MONTHLY")],
        "status_quarter": ["o_orderstatus", D.date_bucket(c("o_orderdate"), "QUARTERLY")]}, exact=True)
    return f.join(size.select(c("grain").alias("rollup_id"), "agg_rows", "base_rows"), "rollup_id")


CANDS = f"""base AS ({TOP}), cands AS (
    SELECT 'region_month' AS rollup_id, ['region'] AS dims, 'order_date' AS cd, 1 AS fine, (SELECT count(*) FROM (SELECT DISTINCT r_name, date_trunc('month', o_orderdate) FROM base)) AS agg_rows
    UNION ALL SELECT 'nation_region', ['nation', 'region'], NULL, 0, (SELECT count(*) FROM (SELECT DISTINCT n_name, r_name FROM base))
    UNION ALL SELECT 'wide_month', ['nation', 'region', 'segment', 'status'], 'order_date', 1, (SELECT count(*) FROM (SELECT DISTINCT n_name, r_name, c_mktsegment, o_orderstatus, date_trunc('month', o_orderdate) FROM base))
    UNION ALL SELECT 'status_quarter', ['status'], 'order_date', 2, (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, date_trunc('quarter', o_orderdate) FROM base)))"""
SERVED = """served AS (SELECT rollup_id, agg_rows, shape_id, weight FROM shapes JOIN cands ON list_has_all(dims, dimensions) AND list_has_all(dims, filter_columns)
    AND NOT list_contains(measures, 'buyers') AND (date_column IS NULL OR (date_column = cd AND fine <= CASE bucket WHEN 'MONTHLY' THEN 1 ELSE 2 END)))"""


@query("coverage_report", f"""WITH {LOG}, {SHAPES}, {CANDS}, {SERVED}, n AS (SELECT count(*) AS base_rows FROM lineitem),
    g AS (SELECT rollup_id, count(*) AS shapes, sum(weight) AS weight FROM served GROUP BY 1)
    SELECT c.rollup_id, c.agg_rows, coalesce(g.shapes, 0) AS shapes, coalesce(g.weight, 0) AS weight, round(100 * coalesce(g.weight, 0) / (SELECT sum(weight) FROM shapes), 1) AS coverage_pct,
           coalesce(g.weight, 0) * greatest(base_rows - c.agg_rows, 0) AS rows_saved FROM cands c LEFT JOIN g USING (rollup_id), n""")
def coverage_report(t):
    return A.coverage_report(shapes(t), candidates(t), PLANS)


@query("consolidation_report", f"""WITH {LOG}, {SHAPES}, {CANDS}, {SERVED}, narrow AS (SELECT * FROM cands WHERE len(dims) = 1)
    SELECT w.rollup_id AS combined, w.agg_rows AS combined_rows, count(*) AS narrow, sum(n.agg_rows)::BIGINT AS narrow_total_rows FROM cands w JOIN narrow n ON len(w.dims) > 1 AND list_has_all(w.dims, n.dims)
    WHERE EXISTS (SELECT 1 FROM served WHERE served.rollup_id = n.rollup_id)
      AND NOT EXISTS (SELECT 1 FROM served s WHERE s.rollup_id = n.rollup_id AND s.shape_id NOT IN (SELECT shape_id FROM served x WHERE x.rollup_id = w.rollup_id))
    GROUP BY 1, 2 HAVING count(*) >= 2""")
def consolidation_report(t):
    return A.consolidation_report(shapes(t), candidates(t), PLANS)


@query("candidate_grains", f"""WITH {LOG}, {SHAPES}, base AS (SELECT DISTINCT list_sort(list_distinct(list_concat(dimensions, filter_columns))) AS dims, date_column FROM shapes),
    merged AS (SELECT list_sort(list_distinct(list_concat(a.dims, b.dims))) AS dims, a.date_column FROM base a JOIN base b ON a.date_column IS NOT DISTINCT FROM b.date_column AND a.dims < b.dims
               AND len(list_intersect(a.dims, b.dims)) >= 0.5 * len(list_distinct(list_concat(a.dims, b.dims)))),
    whole AS (SELECT list_sort(list_distinct(flatten(list(dims)))) AS dims, date_column FROM base GROUP BY 2),
    g AS (SELECT * FROM base UNION SELECT * FROM merged UNION SELECT * FROM whole),
    s AS (SELECT g.dims, g.date_column, count(*) AS covered, min(CASE sh.bucket WHEN 'MONTHLY' THEN 1 WHEN 'QUARTERLY' THEN 2 END) AS fine FROM g JOIN shapes sh ON list_has_all(g.dims, sh.dimensions) AND list_has_all(g.dims, sh.filter_columns)
          AND NOT list_contains(sh.measures, 'buyers') AND (sh.date_column IS NULL OR sh.date_column = g.date_column) GROUP BY 1, 2)
    SELECT array_to_string(dims, '+') || '|' || coalesce(date_column, '-') AS rollup_id, CASE fine WHEN 1 THEN 'MONTHLY' WHEN 2 THEN 'QUARTERLY' END AS bucket, covered, len(dims) > 8 AS wide_grain FROM s""")
def candidate_grains(t):
    out = A.candidate_grains(shapes(t), PLANS, consolidatable=["nation", "region", "segment", "status"])
    return out.select("rollup_id", "bucket", "covered", "wide_grain")


# Shapes with two dates: the day of the order and the day of the shipment.
_O = f"CASE WHEN value > 15 THEN CASE WHEN {_K} < 50 THEN 'MONTHLY' ELSE 'QUARTERLY' END END"
_S = f"CASE WHEN {_K} % 3 = 0 THEN 'DAILY' WHEN {_K} % 3 = 1 THEN 'YEARLY' END"
LOG2 = f"""log AS (SELECT CASE event_type WHEN 'view' THEN ['region'] WHEN 'click' THEN ['nation', 'region'] WHEN 'purchase' THEN ['nation', 'segment'] ELSE ['status'] END AS dimensions,
    {_O} AS ob, {_S} AS sb, event_type = 'signup' AND {_K} % 3 = 1 AS raw,
    CASE WHEN {_K} > 90 THEN ['status'] WHEN {_K} > 80 THEN ['ship_date'] ELSE [] END AS filter_columns FROM events),
  shapes AS (SELECT concat_ws('|', array_to_string(dimensions, '+'), concat_ws('+', 'order_date@' || ob, CASE WHEN raw THEN 'ship_date' ELSE 'ship_date@' || sb END), array_to_string(filter_columns, '+')) AS shape_id,
    dimensions, ob, CASE WHEN NOT raw THEN sb END AS sb, raw OR sb IS NOT NULL AS ships, filter_columns, count(*)::DOUBLE AS weight FROM log GROUP BY ALL)"""


def shapes2(t):
    names = lambda *n: F.array(*[F.lit(x) for x in n]) if n else F.array().cast("array<string>")
    k, kind = F.get_json_object("props", "$.k").cast("bigint"), c("event_type")
    date = lambda name, bucket: F.struct(F.lit(name).alias("column"), bucket.alias("bucket"))
    ordered = F.when(k < 50, "MONTHLY").otherwise("QUARTERLY")
    shipped = F.when((k % 3 == 1) & (kind == "signup"), None).otherwise(F.when(k % 3 == 0, "DAILY").otherwise("YEARLY"))
    dates = F.array_compact(F.array(F.when(c("value") > 15, date("order_date", ordered)), F.when(k % 3 < 2, date("ship_date", shipped))))
    log = t.events.select(
        F.when(kind == "view", names("region")).when(kind == "click", names("nation", "region")).when(kind == "purchase", names("nation", "segment")).otherwise(names("status")).alias("dimensions"),
        dates.cast(A.DATES).alias("dates"), F.when(k > 90, names("status")).when(k > 80, names("ship_date")).otherwise(names()).alias("filter_columns"))
    return A.query_shapes(log, ["dimensions", "dates", "filter_columns"]).withColumn("measures", names("revenue"))


@query("query_shapes_dates", f"WITH {LOG2} SELECT shape_id, weight FROM shapes")
def query_shapes_dates(t):
    """Shapes that group by two dates, each with its own bucket."""
    return shapes2(t).select("shape_id", "weight")


# Buckets by fineness; -1 is the raw date.
_FINE = "CASE {b} WHEN 'DAILY' THEN 1 WHEN 'MONTHLY' THEN 3 WHEN 'QUARTERLY' THEN 4 WHEN 'YEARLY' THEN 5 ELSE -1 END"
_DATED = f"""(ob IS NULL OR (co IS NOT NULL AND co <= {_FINE.format(b='ob')} )) AND (NOT ships OR (cs IS NOT NULL AND cs <= {_FINE.format(b='sb')}))
    AND list_has_all(dims, list_filter(filter_columns, lambda x: NOT (ships AND x = 'ship_date')))"""
CANDS2 = f"""base AS ({TOP}), cands AS (
    SELECT 'region_month_ship' AS rollup_id, ['region', 'status'] AS dims, 3 AS co, 1 AS cs, (SELECT count(*) FROM (SELECT DISTINCT r_name, o_orderstatus, date_trunc('month', o_orderdate), l_shipdate::DATE FROM base)) AS agg_rows
    UNION ALL SELECT 'nation_year', ['nation', 'region', 'segment'], 3, 5, (SELECT count(*) FROM (SELECT DISTINCT n_name, r_name, c_mktsegment, date_trunc('month', o_orderdate), year(l_shipdate) FROM base))
    UNION ALL SELECT 'all_ship', ['nation', 'region', 'segment', 'status'], NULL, 1, (SELECT count(*) FROM (SELECT DISTINCT n_name, r_name, c_mktsegment, o_orderstatus, l_shipdate::DATE FROM base)))"""


def candidates2(t):
    """Three grains of two dates, their sizes from one lattice."""
    order = lambda b: D.date_bucket(c("o_orderdate"), b)
    ship = lambda b: D.date_bucket(c("l_shipdate"), b)
    size = P.profile_grains(rows(t), {
        "region_month_ship": ["r_name", "o_orderstatus", order("MONTHLY"), ship("DAILY")],
        "nation_year": ["n_name", "r_name", "c_mktsegment", order("MONTHLY"), ship("YEARLY")],
        "all_ship": ["n_name", "r_name", "c_mktsegment", "o_orderstatus", ship("DAILY")]}, exact=True)
    listed = [("region_month_ship", ["region", "status"], [("order_date", "MONTHLY"), ("ship_date", "DAILY")]),
              ("nation_year", ["nation", "region", "segment"], [("order_date", "MONTHLY"), ("ship_date", "YEARLY")]),
              ("all_ship", ["nation", "region", "segment", "status"], [("ship_date", "DAILY")])]
    f = t.spark.createDataFrame(listed, f"rollup_id string, dimensions array<string>, dates {A.DATES}")
    return f.join(size.select(c("grain").alias("rollup_id"), "agg_rows", "base_rows"), "rollup_id")


@query("coverage_report_dates", f"""WITH {LOG2}, {CANDS2}, served AS (SELECT rollup_id, shape_id, weight FROM shapes JOIN cands ON list_has_all(dims, dimensions) AND {_DATED}),
    n AS (SELECT count(*) AS base_rows FROM lineitem), g AS (SELECT rollup_id, count(*) AS shapes, sum(weight) AS weight FROM served GROUP BY 1)
    SELECT c.rollup_id, c.agg_rows, coalesce(g.shapes, 0) AS shapes, coalesce(g.weight, 0) AS weight, round(100 * coalesce(g.weight, 0) / (SELECT sum(weight) FROM shapes), 1) AS coverage_pct,
           coalesce(g.weight, 0) * greatest(base_rows - c.agg_rows, 0) AS rows_saved FROM cands c LEFT JOIN g USING (rollup_id), n""")
def coverage_report_dates(t):
    return A.coverage_report(shapes2(t), candidates2(t), PLANS)


@query("candidate_grains_dates", f"""WITH {LOG2}, sh AS (SELECT *, list_sort(list_distinct(list_concat(dimensions, list_filter(filter_columns, lambda x: NOT (ships AND x = 'ship_date'))))) AS cols, ob IS NOT NULL AS orders FROM shapes),
    base AS (SELECT DISTINCT cols AS dims, orders, ships FROM sh),
    merged AS (SELECT list_sort(list_distinct(list_concat(a.dims, b.dims))) AS dims, a.orders, a.ships FROM base a JOIN base b ON a.orders = b.orders AND a.ships = b.ships AND a.dims < b.dims
               AND len(list_intersect(a.dims, b.dims)) >= 0.5 * len(list_distinct(list_concat(a.dims, b.dims)))),
    whole AS (SELECT list_sort(list_filter(list_distinct(flatten(list(dims))), lambda x: x <> 'ship_date')) AS dims, orders, ships FROM base GROUP BY 2, 3),
    g AS (SELECT * FROM base UNION SELECT * FROM merged UNION SELECT * FROM whole),
    s AS (SELECT g.dims, g.orders, g.ships, count(*) AS covered, min(CASE WHEN sh.orders THEN {_FINE.format(b='ob')} END) AS fo, min(CASE WHEN sh.ships THEN {_FINE.format(b='sb')} END) AS fs
          FROM g JOIN sh ON list_has_all(g.dims, sh.cols) AND (g.orders OR NOT sh.orders) AND (g.ships OR NOT sh.ships) GROUP BY 1, 2, 3)
    SELECT array_to_string(dims, '+') || '|' || CASE WHEN orders OR ships THEN concat_ws('+', CASE WHEN orders THEN 'order_date' END, CASE WHEN ships THEN 'ship_date' END) ELSE '-' END AS rollup_id,
      concat_ws('+', CASE WHEN orders THEN 'order_date@' || CASE fo WHEN 3 THEN 'MONTHLY' ELSE 'QUARTERLY' END END,
        CASE WHEN ships THEN 'ship_date' || CASE fs WHEN 1 THEN '@DAILY' WHEN 5 THEN '@YEARLY' ELSE '' END END) AS buckets, covered FROM s""")
def candidate_grains_dates(t):
    out = A.candidate_grains(shapes2(t), PLANS, consolidatable=["nation", "region", "segment", "status"])
    named = F.transform("dates", lambda d: F.concat_ws("@", d["column"], d["bucket"]))
    return out.select("rollup_id", F.array_join(named, "+").alias("buckets"), "covered")


def _greedy(steps, served, base):
    """The greedy choice as one CTE a step: the gains against what is chosen, and the first of them."""
    out, chosen = [], "SELECT NULL AS rollup_id WHERE false"
    for k in range(1, steps + 1):
        out.append(f"""best{k} AS (SELECT shape_id, min(agg_rows) AS best FROM {served} WHERE rollup_id IN ({chosen}) GROUP BY 1),
    pick{k} AS (SELECT {k} AS step, * FROM (SELECT rollup_id, any_value(agg_rows) AS agg_rows, sum(weight * greatest(coalesce(best, {base}) - agg_rows, 0))::DOUBLE AS benefit FROM {served} LEFT JOIN best{k} USING (shape_id)
        WHERE rollup_id NOT IN ({chosen}) GROUP BY 1) WHERE benefit > 0 ORDER BY benefit DESC, rollup_id LIMIT 1)""")
        chosen = " UNION ALL ".join(f"SELECT rollup_id FROM pick{i}" for i in range(1, k + 1))
    picks = " UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(1, steps + 1))
    return ", ".join(out) + f""", picks AS ({picks}) SELECT p.step, p.rollup_id, p.benefit,
    round(100 * (SELECT sum(weight) FROM (SELECT DISTINCT shape_id, weight FROM {served} WHERE rollup_id IN (SELECT rollup_id FROM picks q WHERE q.step <= p.step))) / (SELECT sum(weight) FROM shapes), 1) AS coverage_pct"""


_BASE = "(SELECT count(*) FROM lineitem)"


@query("choose_rollups", f"WITH {LOG}, {SHAPES}, {CANDS}, {SERVED}, {_greedy(4, 'served', _BASE)}, round({_BASE} / p.agg_rows::DOUBLE, 1) AS compression FROM picks p")
def choose_rollups(t):
    """A greedy loop over the candidates of the sized kind."""
    return A.choose_rollups(shapes(t), candidates(t), PLANS)


@query("choose_rollups_unsized", f"WITH {LOG}, {SHAPES}, {CANDS}, {SERVED}, free AS (SELECT * REPLACE (0 AS agg_rows) FROM served), {_greedy(4, 'free', 1)}, NULL::DOUBLE AS compression FROM picks p")
def choose_rollups_unsized(t):
    """Candidates whose sizes nobody counted are chosen by the weight they newly serve."""
    return A.choose_rollups(shapes(t), candidates(t).drop("agg_rows", "base_rows"), PLANS)


_TEXT = """CASE event_type WHEN 'view' THEN 'SELECT r_name, sum(x) FROM o GROUP BY region.r_name ORDER BY 1' WHEN 'click' THEN 'select 1 from o group by "NATION"."N_NAME", region.r_name having count(*) > 1'
    WHEN 'purchase' THEN 'SELECT 1 FROM o GROUP BY date_trunc(''MONTH'', orders.o_orderdate), region.r_name LIMIT 5' WHEN 'signup' THEN 'SELECT 1 FROM o GROUP BY customer.c_mktsegment;' ELSE 'SELECT count(*) FROM o' END"""


def query_log(t):
    return t.events.select(F.expr(_TEXT.replace("''MONTH''", '"MONTH"').replace("\n", " ")).alias("query_text"))


@query("mine_query_log", """SELECT CASE event_type WHEN 'view' THEN 'REGION.R_NAME' WHEN 'click' THEN 'NATION.N_NAME,REGION.R_NAME' WHEN 'purchase' THEN 'REGION.R_NAME' ELSE 'CUSTOMER.C_MKTSEGMENT' END AS columns,
    event_type = 'purchase' AS had_dropped, count(*) AS queries FROM events WHERE event_type <> 'error' GROUP BY 1, 2""")
def mine_query_log(t):
    return A.mine_query_log(query_log(t), "query_text").withColumn("columns", F.array_join("columns", ","))


@query("weigh_shapes", f"""WITH {LOG}, {SHAPES}, n AS (SELECT event_type, count(*) AS k FROM events GROUP BY 1)
    SELECT shape_id, 1.0 + coalesce((SELECT sum(k) FROM n WHERE (event_type = 'view' AND dimensions = ['region']) OR (event_type = 'click' AND dimensions = ['nation', 'region'])
        OR (event_type = 'purchase' AND dimensions = ['region'] AND date_column IS NOT NULL)), 0)::DOUBLE AS weight FROM shapes""")
def weigh_shapes(t):
    names = {"REGION.R_NAME": "region", "NATION.N_NAME": "nation", "CUSTOMER.C_MKTSEGMENT": "segment"}
    return A.weigh_shapes(shapes(t), A.mine_query_log(query_log(t), "query_text", names)).select("shape_id", "weight")
