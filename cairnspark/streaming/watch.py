"""Streams of file events: debounced batches, windows with watermarks, upserts of file states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facts import reconciled
from ..operators.joins import upsert

#: Event kinds that change a file (fixed values).
MUTATIONS = ("create", "modify", "remove", "any", "other")


def event_files(spark: SparkSession, folder: str, schema: str, files: int = 1000, size: int | None = None) -> DataFrame:
    """A stream of the event files (JSON lines) of a folder: those that are there come first, in micro-batches of at most `files`
    files, or of about `size` bytes if given, then what arrives."""
    bound = ("maxBytesPerTrigger", size) if size else ("maxFilesPerTrigger", files)
    return spark.readStream.schema(schema).option(*bound).json(folder)


def of_projects(streams: dict[str, DataFrame]) -> DataFrame:
    """One stream of the events of several projects, with the project's name as `project`."""
    return reduce(DataFrame.unionByName, (events.withColumn("project", F.lit(name)) for name, events in sorted(streams.items())))


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet table, each event once, also where a batch runs again."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mutations(events: DataFrame) -> DataFrame:
    return events.where(F.lower("kind").isin(*MUTATIONS))


def debounced(events: DataFrame, gap: str, late: str) -> DataFrame:
    """A row per key and quiet period of events (key, ts): key, start, last end, n. A session ends `gap` after its last event; events
    up to `late` behind the newest still extend theirs. Works on streams and batches."""
    return (
        events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def debounced_replay(events: DataFrame, gap_s: int) -> DataFrame:
    """The same over a table by gaps and islands: key, start, n (at in seconds)."""
    w = Window.partitionBy("key").orderBy("at", "id")
    fresh = F.when(F.lag("at").over(w).isNull() | (F.col("at") - F.lag("at").over(w) >= gap_s), 1).otherwise(0)
    numbered = events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "session").agg(F.min("at").alias("start"), F.max("at").alias("last"), F.count("*").alias("n"))


def windowed(events: DataFrame, width: str, slide: str | None, late: str) -> DataFrame:
    """Counts and sums of events (ts, kind, value) in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def batch_form(sessions: DataFrame, every: str = "1 minute") -> DataFrame:
    """Sorted distinct keys whose quiet period ended in the same stretch of time."""
    return sessions.groupBy(F.window("end", every).alias("w")).agg(F.array_sort(F.collect_set("key")).alias("keys")).select(F.col("w.start").alias("start"), "keys")


def keep_states(stream: DataFrame, path: str, checkpoint: str, key: str, order: list[str], value: str) -> StreamingQuery:
    """Run a stream of file states into a table of the last state per key. Each micro-batch writes a version of its own number
    beside the last one, so a batch that runs again overwrites its own version only."""

    def apply(batch: DataFrame, number: int) -> None:
        newest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
        last = batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        rows = last if number == 0 else upsert(batch.sparkSession.read.parquet(f"{path}/version={number - 1}"), last, [key])
        rows.where(F.col(value).isNotNull()).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = [
    "MUTATIONS", "append", "batch_form", "debounced", "debounced_replay", "event_files", "keep_states", "mutations", "of_projects", "reconciled", "windowed",
]
