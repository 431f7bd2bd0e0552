"""Bucketed rollups of event streams, with bounded state, and sessions.

Every function takes a streaming frame (or a batch one) and returns one of the same
kind. `run_available` drives a streaming frame over what is there and writes parquet,
with its checkpoint in the shared folder, so a restarted query goes on where it was.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from threading import Event

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener

from orrery.operators.keys import join_on
from orrery.operators.segments import cut_hot, micros
from orrery.session import fresh_path

RUNS = "run string, batches long, rows long, dropped long"
LISTENER_SECONDS = 120


def read_events(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; `ts` becomes an instant, which watermarks need."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, dims: Sequence[str], measures: Mapping[str, Column], late: str = "0 seconds") -> DataFrame:
    """Measures per bucket of the event time and dims; a bucket closes once the watermark passes it."""
    w = F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), *dims).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(F.col("w.start").alias("bucket"), *dims, *measures)


def trailing(events: DataFrame, size: str, slide: str, dims: Sequence[str], measures: Mapping[str, Column], late: str = "0 seconds") -> DataFrame:
    """Measures over the `size` that ends at each multiple of `slide`."""
    w = F.window("ts", size, slide)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), *dims).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(F.col("w.end").alias("until"), *dims, *measures)


def deduplicated(events: DataFrame, keys: Sequence[str], late: str) -> DataFrame:
    """Each key once among rows that arrive within the delay of one another."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


@dataclass
class Progress:
    """What a run did: batches, rows read, and rows that came behind the watermark and were dropped."""

    batches: int = 0
    rows: int = 0
    dropped: int = 0


class _Tally(StreamingQueryListener):
    """Adds up the progress of every run as its batches end, whatever number of them there is."""

    def __init__(self):
        self.runs: dict[str, Progress] = defaultdict(Progress)
        self.ended: dict[str, Event] = defaultdict(Event)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p, run = event.progress, self.runs[str(event.progress.runId)]
        run.batches += 1
        run.rows += max(0, p.numInputRows)
        run.dropped += sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended[str(event.runId)].set()


def run_available(
    df: DataFrame, label: str, mode: str = "append", paths: tuple[str, str] | None = None
) -> tuple[DataFrame, Progress]:
    """Process what is available, to parquet; returns the written rows and the progress of this run.

    A listener counts while the batches run, so the session's options stay as they are. The counts of every
    finished run are also appended to a table beside the state, which `progress_of` adds up.
    `paths` (output, state) of an earlier run go on from where it ended.
    In update mode each batch's changed rows are written under its number, so a batch
    that is run again replaces its own output; the last version of a row has the
    greatest `batch`.
    """
    spark = df.sparkSession
    out, state = paths or (fresh_path(spark, label), fresh_path(spark, label + "-state"))
    writer = df.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    tally = _Tally()
    spark.streams.addListener(tally)
    try:
        if mode == "append":
            q = writer.outputMode("append").format("parquet").option("path", out).start()
        else:
            def keep(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

            q = writer.outputMode(mode).foreachBatch(keep).start()
        q.awaitTermination()
        # The end is told after all progress, on the listener's own thread.
        if not tally.ended[str(q.runId)].wait(LISTENER_SECONDS):
            raise TimeoutError(f"the end of stream {label} was not told within {LISTENER_SECONDS} s: its counts are not whole")
    finally:
        spark.streams.removeListener(tally)
    run = tally.runs[str(q.runId)]
    spark.createDataFrame([(str(q.runId), run.batches, run.rows, run.dropped)], RUNS).write.mode("append").parquet(f"{state}-runs")
    schema = df.schema if mode == "append" else T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(out), run


def progress_of(spark: SparkSession, state: str) -> DataFrame:
    """Runs, batches, rows and dropped rows of all finished runs over one state, restarts included."""
    runs = spark.read.schema(RUNS).parquet(f"{state}-runs")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return runs.agg(F.count_distinct("run").alias("runs"), total("batches"), total("rows"), total("dropped"))


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last version of each row of an update-mode sink."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def sessions(events: DataFrame, user: str, ts: str, gap_seconds: int, measures: Mapping[str, Column]) -> DataFrame:
    """Sessions of a batch of events: a new one starts after `gap_seconds` without an event. Events without a time have none.

    Events are shuffled once by user, and windows find and number the breaks. The time lines of hot users are cut
    into segments of about equally many events (`segments`); into each comes the last time before it and
    the number of sessions begun by then, from one row per (hot user, segment).
    """
    rows = events.where(F.col(ts).isNotNull())
    cuts = cut_hot(rows.select(user, ts), [user], ts)
    parts = [user]
    if cuts:
        rows, parts = cuts.on(rows, ts), [user, "_seg", "_share"]
        at = [user, "_seg"]
        is_hot = F.broadcast(cuts.table.select(F.col(user).alias("_hot")))
        hot = rows.join(is_hot, F.col(user).eqNullSafe(F.col("_hot")), "left_semi")
        ahead = W.partitionBy(user).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
        # One row per hot user and segment: at most two per shuffle partition.
        line = join_on(cuts.numbered(), hot.groupBy(*at).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last")), at, "left")
        line = line.withColumn("_before", F.max("_last").over(ahead)).select(*at, "_first", "_before")
        rows = join_on(rows, F.broadcast(line), at, "left")
    inside = W.partitionBy(*parts).orderBy(ts)

    def opens(before: Column, now: Column) -> Column:
        # Equal instants follow one another without a break, whatever order they are read in.
        gone = micros(now) - micros(before)
        return (before.isNull() | ((gone >= gap_seconds * 1_000_000) & (gone > 0))).cast("int")

    def marked(df: DataFrame) -> DataFrame:
        before = F.lag(ts).over(inside)
        return df.withColumn("_open", opens(F.coalesce(before, F.col("_before")) if cuts else before, F.col(ts)))

    numbered = marked(rows).withColumn("_local", F.sum("_open").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow)))
    number = F.col("_local")
    if cuts:
        # All rows of an instant lie in the session that its first row opens or goes on with.
        whole = opens(F.col("_before"), F.col("_first"))
        hot = join_on(hot, F.broadcast(line), at, "left")
        counts = marked(hot).groupBy(*at).agg(F.max(F.when(F.col("_instant"), whole)).alias("_once"), F.sum("_open").alias("_n"))
        base = join_on(cuts.numbered(), counts, at, "left").select(
            *at, F.coalesce(F.sum(F.coalesce("_once", "_n")).over(ahead), F.lit(0)).alias("_base"))
        numbered = join_on(numbered, F.broadcast(base), at, "left")
        number = F.coalesce("_base", F.lit(0)) + F.when(F.col("_instant"), whole).otherwise(F.col("_local"))
    return numbered.withColumn("session", number).groupBy(user, "session").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), *[m.alias(n) for n, m in measures.items()]
    )


def stream_sessions(events: DataFrame, user: str, gap: str, measures: Mapping[str, Column], late: str = "0 seconds") -> DataFrame:
    """The same for a stream, with Spark's session windows."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), user).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("closes"), *measures)
