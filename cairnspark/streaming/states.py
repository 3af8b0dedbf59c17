"""Streams with state of their own per key: debounce by processing time, reconciliation with the last hash, rings of last events.

All three keep their state in the checkpoint (RocksDB), so a restarted stream goes on where it stopped and no table is rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Streams of this session that start from now on keep their state in RocksDB, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class _Debounce(StatefulProcessor):
    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, kind string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, kind = self.seen.get() if self.seen.exists() else (0, None)
        for frame in rows:
            if len(frame):
                n, kind = n + len(frame), frame.sort_values("seq", kind="stable")["kind"].iloc[-1]
        self.seen.update((n, kind))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame({"path": pd.Series(dtype=str), "n": pd.Series(dtype="int64"), "kind": pd.Series(dtype=str)})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, kind = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"path": [key[0]], "n": [n], "kind": [kind]})

    def close(self) -> None:
        pass


def debounced_live(events: DataFrame, quiet_ms: int = 500) -> DataFrame:
    """(path, n, kind) of a stream of events (path, seq, kind) once a path had none for `quiet_ms` of processing time: how many there
    were and the last one's kind. Each event moves its path's timer; a restart finds counts and timers as they were."""
    return events.groupBy("path").transformWithStateInPandas(
        _Debounce(quiet_ms), outputStructType="path string, n long, kind string", outputMode="Append", timeMode="ProcessingTime"
    )


class _Reconcile(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "hash string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        last = self.stored.get()[0] if self.stored.exists() else None
        outcomes = []
        for now in frame["hash"]:
            now = None if pd.isna(now) else now
            outcomes.append(("absent" if last is None else "deleted") if now is None else "unchanged" if now == last else "new" if last is None else "reindexed")
            last = now
        if last is None:
            self.stored.clear()
        else:
            self.stored.update((last,))
        yield pd.DataFrame({"path": key[0], "seq": frame["seq"].to_numpy(), "outcome": outcomes})

    def close(self) -> None:
        pass


def reconciled_live(files: DataFrame) -> DataFrame:
    """(path, seq, outcome) of a stream of looks at files (path, seq, hash; null when the file is gone): new, reindexed, unchanged,
    deleted or absent against the hash that was there last. Looks that come together count in order of seq; state is a hash per
    path that is there."""
    kind = files.schema["path"].dataType.simpleString()
    return files.groupBy("path").transformWithStateInPandas(
        _Reconcile(), outputStructType=f"path {kind}, seq long, outcome string", outputMode="Update", timeMode="None"
    )


class _Ring(StatefulProcessor):
    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "seq long, event string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = list(self.last.get()) if self.last.exists() else []
        for frame in rows:
            newest = frame.nlargest(self.size, "seq")
            kept = sorted([*kept, *zip(newest["seq"].tolist(), newest["event"].tolist(), strict=True)])[-self.size :]
        self.last.put([(int(s), e) for s, e in kept])
        yield pd.DataFrame({"key": key[0], "place": range(1, len(kept) + 1), "seq": [s for s, _ in kept], "event": [e for _, e in kept]})

    def close(self) -> None:
        pass


def last_events(events: DataFrame, size: int) -> DataFrame:
    """The last `size` events of each key of a stream (key, seq, event), oldest first: (key, place, seq, event), whole again for each
    key that a micro-batch has events of. State is bounded by `size` a key, whatever the length of the stream."""
    kind = events.schema["key"].dataType.simpleString()
    return events.groupBy("key").transformWithStateInPandas(
        _Ring(size), outputStructType=f"key {kind}, place long, seq long, event string", outputMode="Update", timeMode="None"
    )


def written(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", every: str | None = None) -> StreamingQuery:
    """Run a stream and append each micro-batch's rows under its own number, so one that runs again replaces its own rows only: over
    what has arrived, or on and on with a micro-batch in each stretch of time `every`."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
