"""One key holds a third of all rows: results stay whole and equal to brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from orrery.catalogue import QUERIES
from orrery.operators import aggregates as G, joins as J, keys as K, timeintel as T, windows as V
from orrery.session import settled
from orrery.streaming import rollups as S


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(5)
    n = 6000
    user = np.where(rng.random(n) < 0.34, 1, rng.integers(2, 60, n))
    seconds = rng.integers(0, 20 * 86400, n)
    return pd.DataFrame({"id": np.arange(n), "user": user, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, "s"), "value": rng.integers(0, 50, n).astype(float)})


def test_asof_join(spark, events):
    left, right = events.iloc[::3], events.iloc[1::3].rename(columns={"ts": "at", "value": "seen"})
    best = right.sort_values(["at", "seen"]).drop_duplicates(["user", "at"], keep="last")
    want = pd.merge_asof(left.sort_values("ts"), best[["user", "at", "seen"]].sort_values("at"), left_on="ts", right_on="at", by="user")
    out = J.join_asof(spark.createDataFrame(left[["id", "user", "ts"]]), spark.createDataFrame(right[["user", "at", "seen"]]), ["user"], "ts", "at", ["seen"])
    got = out.select("id", "seen").toPandas().set_index("id").seen
    assert len(got) == len(left)
    pd.testing.assert_series_equal(got.sort_index(), want.set_index("id").seen.sort_index(), check_index_type=False)


def test_asof_join_ignores_null_keys(spark):
    left = spark.createDataFrame([(1, None, "2024-01-02"), (2, 7, "2024-01-02")], "id int, k int, d string").withColumn("ts", F.to_timestamp("d"))
    right = spark.createDataFrame([(None, "2024-01-01", 5), (7, "2024-01-01", 6)], "k int, d string, v int").withColumn("at", F.to_timestamp("d"))
    out = {r.id: r.v for r in J.join_asof(left.drop("d"), right.drop("d"), ["k"], "ts", "at", ["v"]).collect()}
    assert out == {1: None, 2: 6}


def test_range_join(spark, events):
    starts = pd.date_range("2023-12-20", periods=9, freq="5D")
    spans = pd.DataFrame({"a": starts, "b": starts + pd.Timedelta(days=12), "label": range(9)})
    spans.loc[8, "b"] = pd.NaT  # open end
    out = J.join_range(spark.createDataFrame(events), spark.createDataFrame(spans), "ts", "a", "b")
    got = sorted((r.id, -1 if r.label is None else r.label) for r in out.select("id", "label").collect())
    want = []
    for e in events.itertuples():
        hit = [s.label for s in spans.itertuples() if s.a <= e.ts and (pd.isna(s.b) or e.ts < s.b)]
        want += [(e.id, x) for x in (hit or [-1])]
    assert got == sorted(want)


def test_sessions(spark, events):
    df = events.sort_values(["user", "ts", "id"])
    opens = (df.ts - df.groupby("user").ts.shift()).fillna(pd.Timedelta(days=99)) >= pd.Timedelta(hours=2)
    want = df.assign(s=opens.groupby(df.user).cumsum()).groupby(["user", "s"]).agg(n=("id", "size"), a=("ts", "min")).reset_index()
    got = S.sessions(spark.createDataFrame(events), "user", "ts", 7200, {"n": F.count("*")}).toPandas()
    assert sorted(zip(got.user, got.session, got.n, got.session_start)) == sorted(zip(want.user, want.s, want.n, want.a))


def test_sessions_of_no_user(spark):
    df = spark.createDataFrame([(None, "2024-01-01 23:50:00"), (None, "2024-01-02 00:10:00"), (None, "2024-01-02 09:00:00")], "user int, d string").withColumn("ts", F.to_timestamp("d"))
    assert S.sessions(df, "user", "ts", 7200, {"n": F.count("*")}).count() == 2


def test_ranks_over_the_whole_table(spark, events):
    df = spark.createDataFrame(events)
    got = V.global_ranks(df, "value", descending=True, tie="id", tiles=7).toPandas().sort_values("id").reset_index(drop=True)
    s = events.value
    assert (got["rank"] == s.rank(method="min", ascending=False)).all()
    assert (got["dense_rank"] == s.rank(method="dense", ascending=False)).all()
    order = events.sort_values(["value", "id"], ascending=[False, True]).id.reset_index(drop=True)
    place = pd.Series(order.index + 1, index=order.values).sort_index()
    assert (got["row_number"].values == place.values).all()
    n, k = len(events), 7
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    tile = np.repeat(np.arange(1, k + 1), sizes)
    assert (got["ntile"].values == tile[place.values - 1]).all()


def test_rank_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0), (4, None)], "id int, v double")
    assert {r.id: r["rank"] for r in V.rank(df, "v").collect()} == {3: 1, 1: 2, 2: 3, 4: 3}


@pytest.mark.parametrize("accuracy, held", [(100, 4096), (100, 70), (10_000, 4096)])
def test_percentiles_are_exact(spark, events, accuracy, held):
    df = spark.createDataFrame(events)
    out = G.percentiles(df, ["user"], "value", {"m": (0.5, "cont"), "p": (0.93, "cont"), "d": (0.25, "disc"), "lo": (0.0, "disc"), "hi": (1.0, "cont")}, accuracy, held)
    got = out.toPandas().set_index("user").sort_index()
    g = events.groupby("user").value
    for name, want in (("m", g.quantile(0.5)), ("p", g.quantile(0.93)), ("d", g.apply(lambda x: np.quantile(x, 0.25, method="inverted_cdf"))), ("lo", g.min()), ("hi", g.max())):
        np.testing.assert_allclose(got[name].values, want.sort_index().values, rtol=0, atol=1e-9, err_msg=name)


def test_percentile_of_one_value_and_nulls(spark):
    df = spark.createDataFrame([("a", 4.0), ("a", None), ("b", 1.0), ("b", 2.0), ("c", None)], "g string, v double")
    assert {r.g: r.m for r in G.percentiles(df, ["g"], "v", {"m": (0.5, "cont")}).collect()} == {"a": 4.0, "b": 1.5, "c": None}


def test_nth_by_value_counts_repeats(spark):
    df = spark.createDataFrame([("a", x) for x in (9.0, 9.0, 7.0, 5.0)] + [("b", 1.0)], "g string, v double")
    assert {r.g: r.v3 for r in G.nth_by_value(df, ["g"], "v", 3, "v3").collect()} == {"a": 7.0, "b": None}


def test_point_in_time_count(spark, events):
    span = events.groupby("user").ts.agg(["min", "max"]).reset_index().rename(columns={"min": "a", "max": "b"})
    span.loc[span.user % 5 == 0, "b"] = pd.NaT
    got = T.point_in_time_count(spark.createDataFrame(span), [], "a", "b", "2024-01-03", "2024-01-15").toPandas()
    for r in got.itertuples():
        d = pd.Timestamp(r.day)
        a, b = span.a.dt.normalize(), span.b.dt.normalize()
        assert r.active == ((a <= d) & (b.isna() | (d < b)) & (b.isna() | (a < b))).sum()


def tasks_with_rows(df):
    """How many partitions of the result hold rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.fixture
def shuffled(spark):
    """No broadcast and no merging of small partitions, as where all sides are large."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def lengths_of_all_kinds():
    """Intervals of a second to centuries, open, empty and inverted ones, and a repeated one."""
    at = pd.Timestamp("2024-01-03")
    spans = [(at, at + pd.Timedelta(seconds=1)), (at, at + pd.Timedelta(hours=7)), (at - pd.Timedelta(days=3), at + pd.Timedelta(days=3)),
             (pd.Timestamp("1800-01-01"), pd.Timestamp("2100-01-01")), (None, at), (at, None), (None, None), (at, at), (at, at - pd.Timedelta(days=1)),
             (at, at + pd.Timedelta(hours=7))]
    return [(a, b, i % 2, i) for i, (a, b) in enumerate(spans)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("picked", [slice(None), slice(1, 2), slice(0, 3), slice(0, 0)])
def test_range_join_of_all_lengths(spark, how, keyed, picked):
    spans = lengths_of_all_kinds()[picked]
    at = pd.Timestamp("2024-01-03")
    rows = [(at + pd.Timedelta(minutes=m), m % 3, m // 400) for m in range(-900, 900, 100)] + [(None, 0, 0), (at, None, 5), (at, 1, 5), (at, 1, 5)]
    none = lambda x: None if pd.isna(x) else x.to_pydatetime()
    left = spark.createDataFrame([(none(t) if t is not None else None, k, v) for t, k, v in rows], "ts timestamp, k int, v int")
    right = spark.createDataFrame([(a and none(a), b and none(b), k, i) for a, b, k, i in spans], "a timestamp, b timestamp, g int, i int")
    out = J.join_range(left, right, "ts", "a", "b", keys=[("k", "g")] if keyed else (), how=how)
    got = sorted(((r.ts, r.k, r.v, r.i if how in ("left", "inner") else None) for r in out.collect()), key=str)
    want = []
    for t, k, v in rows:
        hit = [i for a, b, g, i in spans if t is not None and (not keyed or k == g) and (a is None or t >= a) and (b is None or t < b)]
        row = (None if t is None else t.to_pydatetime(), k, v)
        if how == "inner" or (how == "left" and hit):
            want += [(*row, i) for i in hit]
        elif how == "left" or (how == "left_semi") == bool(hit):
            want.append((*row, None))
    assert got == sorted(want, key=str)


def test_range_join_without_keys_is_many_tasks(spark, shuffled):
    rows = spark.range(4000, numPartitions=4).select((F.lit("2024-01-03").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, id % 9)")).alias("ts"))
    spans = spark.createDataFrame([("2024-01-01", "2024-01-08", 1)], "a string, b string, i int").select(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"), "i")
    out = J.join_range(rows, spans, "ts", "a", "b", how="inner")
    assert out.count() == 4000 and tasks_with_rows(out) == 8
    same = rows.select(F.lit("2024-01-03").cast("timestamp").alias("ts"))  # one row, four thousand times
    assert tasks_with_rows(J.join_range(same, spans, "ts", "a", "b")) > 2


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") + df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_sides_are_read_once(spark, t):
    lines = t.lineitem.select("l_shipdate", "l_quantity")
    spans = t.orders.select(F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("b"))
    assert scans(J.join_range(lines, spans, "l_shipdate", "a", "b")) == 2
    buys = t.events.select("event_id", "user_id", "ts")
    clicks = t.events.select("user_id", F.col("ts").alias("at"), "value")
    assert scans(J.join_asof(buys, clicks, ["user_id"], "ts", "at", ["value"])) == 2
    assert scans(S.sessions(t.events, "user_id", "ts", 7200, {"n": F.count("*")})) == 1


def hot_events():
    """Nine tenths of the events on one user and one day, a third of all at one instant; some without user or time."""
    rng = np.random.default_rng(8)
    day = pd.Timestamp("2024-01-05")
    ts = [day + pd.Timedelta(seconds=int(s)) for s in rng.integers(0, 86_400, 1200)] + [day + pd.Timedelta(hours=9)] * 800
    users = [1] * 2000
    ts += [day + pd.Timedelta(minutes=int(m)) for m in rng.integers(0, 9000, 300)]
    users += [None if u == 0 else int(u) for u in rng.integers(0, 20, 300)]
    return pd.DataFrame({"id": range(2300), "user": pd.array(users, "Int64"), "ts": ts, "value": rng.integers(0, 50, 2300)})


def as_rows(df):
    return [(int(r.id), None if pd.isna(r.user) else int(r.user), r.ts.to_pydatetime(), int(r.value)) for r in df.itertuples()]


HOT = "id int, user int, ts timestamp, value int"


def test_asof_of_a_hot_key(spark, shuffled):
    e = hot_events()
    left, right = e[e.id % 3 > 0], e[e.id % 3 == 0]
    rows = [*as_rows(left), (9001, 1, None, 0), (9002, None, None, 0)]
    hits = spark.createDataFrame([*as_rows(right), (9003, 1, None, 99)], HOT).select("user", F.col("ts").alias("at"), F.col("value").alias("v"))
    out = J.join_asof(spark.createDataFrame(rows, HOT), hits, ["user"], "ts", "at", ["v"])
    got = {r.id: (r["at"], r.v) for r in out.collect()}
    known = {}
    for r in right.dropna().itertuples():
        known.setdefault(int(r.user), []).append((r.ts.to_pydatetime(), int(r.value)))
    want = {i: max([x for x in known.get(u, []) if t is not None and x[0] <= t], default=(None, None)) for i, u, t, _ in rows}
    assert got == want
    assert tasks_with_rows(out.where("user = 1")) > 4


def test_sessions_of_a_hot_user(spark, shuffled):
    for gap in (20, 600):
        e = hot_events().sort_values(["user", "ts", "id"])
        ago = e.ts - e.groupby("user", dropna=False).ts.shift()
        opens = ago.fillna(pd.Timedelta(days=99)) >= pd.Timedelta(seconds=gap)
        number = opens.groupby(e.user, dropna=False).cumsum()
        want = e.assign(s=number).groupby(["user", "s"], dropna=False).agg(n=("id", "size"), a=("ts", "min"), b=("ts", "max")).reset_index()
        out = S.sessions(spark.createDataFrame(as_rows(e), HOT), "user", "ts", gap, {"n": F.count("*")})
        got = [(r.user, r.session, r.n, r.session_start, r.session_end) for r in out.collect()]
        key = lambda r: (str(r[0]), r[1])
        want = [(None if pd.isna(r.user) else int(r.user), r.s, r.n, r.a.to_pydatetime(), r.b.to_pydatetime()) for r in want.itertuples()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_percentiles_of_every_group_size(spark):
    """Groups of 1 to 60 rows with ties, at many shares, where brackets are single values and ranks lie beside them."""
    rng = np.random.default_rng(12)
    data = pd.DataFrame([(n, float(v)) for n in range(1, 61) for v in rng.integers(0, 40, n)], columns=["g", "v"])
    shares = (0.0, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.9, 1.0)
    wanted = {f"c{i}": (p, "cont") for i, p in enumerate(shares)} | {f"d{i}": (p, "disc") for i, p in enumerate(shares)}
    for groups in (["g"], []):
        got = G.percentiles(spark.createDataFrame(data), groups, "v", wanted).toPandas()
        got = got.sort_values("g") if groups else got
        parts = [x.v for _, x in data.groupby("g")] if groups else [data.v]
        for i, p in enumerate(shares):
            np.testing.assert_allclose(got[f"c{i}"], [x.quantile(p) for x in parts], rtol=0, atol=1e-9)
            np.testing.assert_allclose(got[f"d{i}"], [np.quantile(x, p, method="inverted_cdf") for x in parts])


def test_percentiles_open_large_brackets(spark):
    """All values are distinct and in one group: brackets are narrowed by ranges until few values are left."""
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    got = G.percentiles(df, [], "v", {"a": (0.5, "cont"), "b": (0.123, "cont"), "c": (0.9, "disc"), "z": (1.0, "cont")}, accuracy=50, held=200).first()
    assert (got.a, got.c, got.z) == (24_999.5, 44_999.0, 49_999.0)
    assert got.b == pytest.approx(0.123 * 49_999)
    none = G.percentiles(df.where("v < 0"), [], "v", {"a": (0.5, "cont")}).collect()
    assert [r.a for r in none] == [None]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tallying_plan(monkeypatch, query):
    """The plan by which `query` counts the rows around its brackets, and its rows."""
    plans = {}

    def noted(df):
        done = settled(df)
        plans["_kept" in df.columns] = plan_of(df)
        return done

    monkeypatch.setattr(G, "settled", noted)
    out = query().collect()
    return plans[True], out


def test_percentiles_leave_the_rows_of_large_groups_where_they_lie(spark, shuffled, monkeypatch):
    """Three groups: shuffled by them, the rows would lie in three tasks, whatever their number."""
    df = spark.range(30_000, numPartitions=4).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    wanted = {"m": (0.5, "cont"), "p": (0.25, "cont")}
    plan, out = tallying_plan(monkeypatch, lambda: G.percentiles(df, ["g"], "v", wanted, accuracy=100, held=50))
    assert {r.g: (r.m, r.p) for r in out} == {g: (g + 14_998.5, g + 7_499.25) for g in range(3)}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_discrete_percentile_leaves_rows_where_they_lie(spark, t, shuffled, monkeypatch):
    plan, out = tallying_plan(monkeypatch, lambda: QUERIES["agg_percentile_disc"](spark, SMALL))
    want = t.lineitem.select("l_returnflag", "l_extendedprice").toPandas().groupby("l_returnflag").l_extendedprice
    assert {r.l_returnflag: r.p90 for r in out} == {k: np.quantile(x, 0.9, method="inverted_cdf") for k, x in want}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_percentiles_of_hot_and_many_small_groups(spark, shuffled):
    """More groups than are broadcast at once; two of them, one of NULL keys, hold most rows; brackets are cut into ranges."""
    rng = np.random.default_rng(3)
    g = np.concatenate([np.zeros(9_000), np.full(5_000, np.nan), rng.integers(1, 60, 3_000)])
    data = pd.DataFrame({"g": pd.array(g, "Int64"), "v": rng.permutation(len(g)).astype(float)})
    df = spark.createDataFrame([(None if pd.isna(a) else int(a), float(b)) for a, b in zip(data.g, data.v)], "g int, v double")
    for accuracy, held in ((10_000, 4096), (20, 100)):
        got = G.percentiles(df, ["g"], "v", {"c": (0.9, "cont"), "d": (0.3, "disc")}, accuracy, held).collect()
        want = {None if pd.isna(k) else int(k): x.v for k, x in data.groupby("g", dropna=False)}
        assert len(got) == len(want)
        for r in got:
            assert r.c == pytest.approx(want[r.g].quantile(0.9), abs=1e-9)
            assert r.d == np.quantile(want[r.g], 0.3, method="inverted_cdf")


def test_rows_beside_their_group(spark, shuffled):
    """Equal to a plain join, whatever the groups' sizes; rows of hot groups stay in the tasks that they lie in."""
    for groups, share in ((1, 0.5), (12, 0.5), (200, 0.5), (200, 0.0)):
        key = F.when(F.col("id") >= share * 4000, F.col("id") % groups)  # NULL for the others
        df = spark.range(4000).repartition(8).select(key.alias("k"), (F.col("id") % 5).alias("v"))  # with equal rows
        table = settled(df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("t")))
        out = K.beside_group(df, table, ["k"], "n")
        assert out.columns == ["k", "v", "n", "t"]
        assert sorted(out.collect(), key=str) == sorted(K.join_on(df, table, ["k"]).collect(), key=str)
        assert share == 0 or tasks_with_rows(out.where("k IS NULL")) > 4
    few = table.where("k = 3")
    assert K.beside_group(df, few, ["k"], "n").count() == few.first().n
    assert K.beside_group(df, table.where("false"), ["k"], "n").count() == 0


def test_approximate_percentiles_leave_rows_where_they_lie(spark, shuffled):
    plan = plan_of(QUERIES["agg_percentile_approx"](spark, SMALL))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
