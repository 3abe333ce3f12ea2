"""State per key with lists, expiry and timers: rings of the latest rows, and schedules that come due.

Both keep their state in RocksDB (``with_rocksdb``), so it may grow beyond memory and is written by changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Ring(StatefulProcessor):
    """The latest ``most`` rows of a key by order, forgotten ``ttl_ms`` after they came, if that is given."""

    def __init__(self, most: int, ttl_ms: int | None):
        self.most, self.ttl = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "place long, value string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        held = {int(place): value for place, value in self.rows.get()} if self.rows.exists() else {}
        for part in rows:
            held.update(zip(part["place"].astype("int64").tolist(), part["value"].tolist(), strict=True))
            if len(held) > 2 * self.most:  # never many more than are kept, however large the batch
                held = {p: held[p] for p in sorted(held)[-self.most :]}
        kept = sorted(held)[-self.most :]
        self.rows.put([(p, held[p]) for p in kept])
        yield pd.DataFrame({"key": pd.Series([key[0]], dtype=object), "kept": [len(kept)], "oldest": [kept[0]], "newest": [kept[-1]], "last_value": pd.Series([held[kept[-1]]], dtype=object)})

    def close(self) -> None:
        pass


def ring(rows: DataFrame, key: str, place: str, value: str, most: int, ttl_ms: int | None = None) -> DataFrame:
    """(key, kept, oldest, newest, last_value) after each batch, of the latest ``most`` rows of each key.

    ``place`` (long) orders a key's rows and names each once; a row that comes again changes nothing.  With ``ttl_ms``,
    rows leave that long after they came, by processing time.  State per key is bounded by ``most``.
    """
    named = rows.select(F.col(key).cast("string").alias("key"), F.col(place).cast("long").alias("place"), F.col(value).cast("string").alias("value")).where("key IS NOT NULL AND place IS NOT NULL")
    return named.groupBy("key").transformWithStateInPandas(Ring(most, ttl_ms), "key string, kept long, oldest long, newest long, last_value string", "Update", "None" if ttl_ms is None else "ProcessingTime")


#: Times due after which a key's are handed on.
TIMES = 100_000


def due_rows(key, times: list[np.ndarray]) -> pd.DataFrame:
    due = np.concatenate(times).astype("int64")
    return pd.DataFrame({"key": pd.Series([key[0]] * len(due), dtype=object), "due": due})


class Schedule(StatefulProcessor):
    """When a schedule is next due; a timer brings it up as the watermark passes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("schedule", "due long, every long")

    def put(self, before: tuple[int, int] | None, after: tuple[int, int] | None) -> None:
        """Sets the schedule and its timer, with as few calls as there are changes to either."""
        if before is not None and (after is None or after[0] != before[0]):
            self.handle.deleteTimer(before[0])
        if after is None and before is not None:
            self.state.clear()
        if after is not None and after != before:
            self.state.update(after)
        if after is not None and (before is None or after[0] != before[0]):
            self.handle.registerTimer(after[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All changes of a batch are followed here; the state is read once before them and written once after."""
        before = tuple(map(int, self.state.get())) if self.state.exists() else None
        held, found, size = before, [], 0
        changes = pd.concat([part[["at_ms", "place", "every_ms", "enabled"]] for part in rows]).sort_values(["at_ms", "place"])
        for at, every, enabled in zip(*(changes[c].tolist() for c in ("at_ms", "every_ms", "enabled")), strict=True):
            if held is not None and held[0] < at:  # what was due before the change
                found.append(np.arange(held[0], at, held[1]))
                size += len(found[-1])
            held = (at + every, every) if enabled and every > 0 else None
            if size >= TIMES:
                yield due_rows(key, found)
                found, size = [], 0
        self.put(before, held)
        if found:
            yield due_rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            due, every = map(int, self.state.get())
            times = np.arange(due, timerValues.getCurrentWatermarkInMs() + 1, every)
            if len(times):  # the timer that expired goes by itself
                after = int(times[-1]) + every
                self.state.update((after, every))
                self.handle.registerTimer(after)
                yield due_rows(key, [times])

    def close(self) -> None:
        pass


def due_schedules(changes: DataFrame, key: str, ts: str, place: str, every_s: str, enabled: str, late: str = "1 second") -> DataFrame:
    """(key, due): every time at which a schedule is due, once, from a stream of changes to schedules.

    A change sets a schedule from its own time on: due after each interval, until the next change or as far as the
    watermark has come; a disabled one is due no more.  Changes of a key come in order of time, at most ``late`` after the
    latest change of all; ``place`` breaks ties.
    Timers are part of the checkpoint, so a restart neither repeats nor loses a time.
    """
    stamped = changes.select(
        F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at_"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"), F.col(place).cast("long").alias("place"),
        (F.col(every_s) * 1000).cast("long").alias("every_ms"), F.col(enabled).cast("boolean").alias("enabled"),
    ).where("key IS NOT NULL")
    return stamped.withWatermark("at_", late).groupBy("key").transformWithStateInPandas(Schedule(), "key string, due long", "Append", "EventTime").select("key", F.timestamp_millis("due").alias("due"))
