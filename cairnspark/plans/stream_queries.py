"""Queries that run a stream with state over a whole table and read what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import states as S
from .catalog import query
from .model import read
from .storage import shared_path


def _run(spark, d, name, seq, columns, make):
    """The rows that a stream over the table writes when it arrives in three parts; the stream is started anew for each of them."""
    S.with_state_store(spark)
    rows, out = read(spark, d, name), shared_path(spark, "stream")
    end = (rows.agg(F.max(seq)).first()[0] or 0) + 1
    for i in range(3):
        rows.where((F.col(seq) >= end * i // 3) & (F.col(seq) < end * (i + 1) // 3)).write.mode("append").parquet(f"{out}/log")
        stream = spark.readStream.schema(rows.schema).parquet(f"{out}/log").select(*columns)
        S.written(make(stream), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(
    "z6_stream_outcomes",
    """WITH e AS (SELECT user_id AS path, event_id AS seq, CASE WHEN event_type <> 'error' THEN event_type END AS hash FROM events), p AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY seq) AS last FROM e)
      SELECT path, seq, CASE WHEN hash IS NULL THEN CASE WHEN last IS NULL THEN 'absent' ELSE 'deleted' END WHEN last IS NULL THEN 'new' WHEN hash = last THEN 'unchanged' ELSE 'reindexed' END AS outcome FROM p""",
)
def _(spark, d):
    hashed = F.when(F.col("event_type") != "error", F.col("event_type")).alias("hash")
    return _run(spark, d, "events", "event_id", [F.col("user_id").alias("path"), F.col("event_id").alias("seq"), hashed], S.reconciled_live).drop("batch")


@query(
    "z9_last_events",
    """SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS place, seq, event FROM (SELECT user_id AS key, event_id AS seq, event_type AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20""",
)
def _(spark, d):
    columns = [F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("event")]
    rows = _run(spark, d, "events", "event_id", columns, lambda s: S.last_events(s, 20))
    # a key's ring is what its newest batch wrote
    newest = rows.groupBy("key").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["key", "batch"]).drop("batch")
