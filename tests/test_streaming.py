"""Streams over several arrivals: late rows, repeats, restarts."""

import datetime as dt

from pyspark.sql import functions as F, types as T

from orrery.session import fresh_path
from orrery.streaming import rollups as S

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("user", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType())])


def at(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)


def test_closed_buckets_are_emitted_once_and_late_rows_dropped(spark):
    folder, paths = fresh_path(spark, "in"), (fresh_path(spark, "out"), fresh_path(spark, "state"))

    def run():
        once = S.deduplicated(S.read_events(spark, folder, SCHEMA), ["id"], "30 minutes")
        w = F.window("ts", "1 hour")
        hourly = once.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "n")
        out, progress = S.run_available(hourly, "late", paths=paths)
        return {r.bucket.hour: r.n for r in out.collect()}, progress.dropped

    arrive(spark, folder, [(1, "a", at(1), 1.0), (2, "a", at(1, 10), 1.0), (3, "b", at(3), 1.0)])
    first, late = run()
    assert first == {1: 2} and late == 0  # the watermark stands at 02:30
    arrive(spark, folder, [(4, "a", at(1, 30), 1.0), (5, "a", at(2, 40), 1.0), (3, "b", at(3), 1.0), (6, "c", at(5), 1.0)])
    second, late = run()
    assert second == {1: 2, 2: 1, 3: 1} and late == 1  # 4 came too late, 3 came twice


def test_update_mode_keeps_the_latest_version(spark):
    folder, paths = fresh_path(spark, "in"), (fresh_path(spark, "out"), fresh_path(spark, "state"))

    def run():
        out, _ = S.run_available(S.tumbling(S.read_events(spark, folder, SCHEMA), "1 hour", ["user"], {"total": F.sum("value")}, "1 hour"), "up", "update", paths)
        return {(r.bucket.hour, r.user): r.total for r in S.latest(out, ["bucket", "user"]).collect()}

    arrive(spark, folder, [(1, "a", at(1), 1.0), (2, "b", at(1), 5.0)])
    assert run() == {(1, "a"): 1.0, (1, "b"): 5.0}
    arrive(spark, folder, [(3, "a", at(1, 5), 2.0)])
    assert run() == {(1, "a"): 3.0, (1, "b"): 5.0}


def test_trailing_overlaps(spark):
    folder = fresh_path(spark, "in")
    arrive(spark, folder, [(1, "a", at(1), 1.0), (2, "a", at(2), 2.0)])
    out, _ = S.run_available(S.trailing(S.read_events(spark, folder, SCHEMA), "2 hours", "1 hour", [], {"total": F.sum("value")}), "tr", "update")
    assert {r.until.hour: r.total for r in S.latest(out, ["until"]).collect()} == {2: 1.0, 3: 3.0, 4: 2.0}


def test_late_rows_of_many_batches_and_a_restart(spark):
    """One file a batch: each brings one row in time and one too late; no session option is touched."""
    option = "spark.sql.streaming.numRecentProgressUpdates"
    before, shuffles = spark.conf.get(option), spark.conf.get("spark.sql.shuffle.partitions")
    folder, paths = fresh_path(spark, "in"), (fresh_path(spark, "out"), fresh_path(spark, "state"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")

    def batches(first, n):
        day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
        for i in range(first, first + n):
            arrive(spark, folder, [(2 * i, "a", day(i), 1.0), (2 * i + 1, "a", day(i - 50), 1.0)])
        once = S.deduplicated(S.read_events(spark, folder, SCHEMA, max_files=1), ["id"], "1 hour")
        return S.run_available(once, "many", paths=paths)[1]

    try:
        # Eight files to a write: the rows of a batch may lie in two files, so batches are at least the writes.
        a, b = batches(0, 104), batches(104, 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert a.batches >= 104 and (a.rows, b.rows) == (208, 8)
    assert spark.conf.get(option) == before
    total = S.progress_of(spark, paths[1]).first()
    assert (total.runs, total.rows, total.dropped) == (2, 216, a.dropped + b.dropped)
    kept = spark.read.parquet(paths[0]).count()
    assert kept + total.dropped == 216 and total.dropped >= 100
