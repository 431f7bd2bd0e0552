"""Streams over the event table, driven to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.catalogue.registry import query
from orrery.session import fresh_path
from orrery.streaming import rollups as S

c = F.col
R = F.round


def events(t):
    return S.read_events(t.spark, t.folder, t.events.schema, "events.parquet")


measures = lambda: {"n": F.count("*"), "total": F.sum("value")}
r2 = lambda df: df.withColumn("total", R("total", 2))
MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("rollup_stream_tumbling", f"""SELECT bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, date_trunc('hour', ts) AS bucket FROM events)
    WHERE bucket + INTERVAL 1 HOUR <= date_trunc('milliseconds', {MARK}) GROUP BY 1, 2""")
def rollup_stream_tumbling(t):
    """Closed hours only: append mode emits a bucket once the watermark has passed it."""
    out, _ = S.run_available(S.tumbling(events(t), "1 hour", ["event_type"], measures(), "10 minutes"), "tumbling")
    return r2(out)


@query("rollup_stream_trailing", """SELECT until, event_type, count(*) AS n, round(sum(value), 2) AS total FROM
    (SELECT *, date_trunc('day', ts) + INTERVAL (floor(hour(ts) / 6) * 6 + 6 * k) HOUR AS until FROM events, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY 1, 2""")
def rollup_stream_trailing(t):
    """The day that ends at every sixth hour, in update mode: the last version of each row counts."""
    out, _ = S.run_available(S.trailing(events(t), "1 day", "6 hours", ["event_type"], measures(), "10 minutes"), "trailing", "update")
    return r2(S.latest(out, ["until", "event_type"]))


@query("rollup_stream_dedupe", f"""SELECT bucket, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, date_trunc('hour', ts) AS bucket FROM events)
    WHERE bucket + INTERVAL 1 HOUR <= date_trunc('milliseconds', (SELECT max(ts) - INTERVAL 1 HOUR FROM events)) GROUP BY 1""")
def rollup_stream_dedupe(t):
    """Every event is delivered twice; each is counted once."""
    folder = fresh_path(t.spark, "twice")
    t.events.union(t.events).write.parquet(folder)
    once = S.deduplicated(S.read_events(t.spark, folder, t.events.schema), ["event_id"], "1 hour")
    w = F.window("ts", "1 hour")
    hourly = once.groupBy(w.alias("w")).agg(*[m.alias(k) for k, m in measures().items()]).select(c("w.start").alias("bucket"), "n", "total")
    out, _ = S.run_available(hourly, "dedupe")
    return r2(out)


@query("rollup_stream_late", """WITH m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS mark FROM events WHERE event_type <> 'error')
    SELECT count(*) FILTER (event_type <> 'error' OR ts > mark) AS kept, count(*) FILTER (event_type = 'error' AND ts <= mark) AS dropped FROM events, m""")
def rollup_stream_late(t):
    """The error events come after all the others: those behind the watermark are dropped and counted."""
    folder, paths = fresh_path(t.spark, "late"), (fresh_path(t.spark, "late-out"), fresh_path(t.spark, "late-state"))
    t.events.filter("event_type <> 'error'").write.mode("append").parquet(folder)

    def arrived():
        return S.run_available(S.deduplicated(S.read_events(t.spark, folder, t.events.schema), ["event_id"], "1 day"), "late", paths=paths)

    arrived()
    t.events.filter("event_type = 'error'").write.mode("append").parquet(folder)
    rows, _ = arrived()
    return S.progress_of(t.spark, paths[1]).select(rows.agg(F.count("*")).scalar().alias("kept"), "dropped")


SESSIONS = """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS o FROM events),
    n AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)"""


@query("session_rollup", SESSIONS + " SELECT user_id, session::BIGINT AS session, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, round(sum(value), 2) AS total FROM n GROUP BY 1, 2")
def session_rollup(t):
    return r2(S.sessions(t.events, "user_id", "ts", 7200, measures()))


@query("session_funnel", SESSIONS + """, f AS (SELECT user_id, session, min(ts) FILTER (event_type = 'view') AS a, min(ts) FILTER (event_type = 'click') AS b FROM n GROUP BY 1, 2)
    SELECT count(*) AS sessions, count(a) AS viewed, count(*) FILTER (a < b) AS clicked FROM f""")
def session_funnel(t):
    first = lambda kind: F.min(F.when(c("event_type") == kind, c("ts")))
    s = S.sessions(t.events, "user_id", "ts", 7200, {"a": first("view"), "b": first("click")})
    return s.agg(F.count("*").alias("sessions"), F.count("a").alias("viewed"), F.count(F.when(c("a") < c("b"), 1)).alias("clicked"))


@query("session_stream", SESSIONS + """ SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 2) AS total FROM n GROUP BY user_id, session
    HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def session_stream(t):
    out, _ = S.run_available(S.stream_sessions(events(t), "user_id", "2 hours", measures(), "10 minutes"), "sessions")
    return r2(out.drop("closes"))
