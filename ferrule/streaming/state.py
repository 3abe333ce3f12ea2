"""Stateful operators on streams: a limiter that blocks, trust that is folded, bounded logs, trends by day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limit_decisions(times: list[float], events: list[float], blocked_until: float, window: float, most: int) -> tuple[list[bool], list[float], float]:
    """Whether each event is let through, with the times and the block that remain.

    An event beyond ``most`` within the trailing window blocks its key until a window after it.
    """
    out = []
    for t in events:
        times = [x for x in times if x > t - window]
        if t < blocked_until:
            out.append(False)
        elif len(times) >= most:
            blocked_until = t + window
            out.append(False)
        else:
            times.append(t)
            out.append(True)
    return out, times, blocked_until


def rate_limit(events: DataFrame, key: str, ts: str, order: str, window_s: float = 60.0, most: int = 10) -> DataFrame:
    """(key, order, allowed) of every event of a stream; state per key is at most ``most`` times and a block."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, blocked = (list(state.get[0]), state.get[1]) if state.exists else ([], 0.0)
        rows = pd.concat(list(parts)).sort_values([ts, order])
        allowed, times, blocked = limit_decisions(times, (rows[ts].astype("datetime64[us]").astype("int64") / 1e6).tolist(), blocked, window_s, most)
        state.update((times, blocked))
        yield pd.DataFrame({key: [k[0]] * len(rows), order: rows[order].to_numpy(), "allowed": allowed})

    return events.select(key, ts, order).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} long, allowed boolean", "times array<double>, blocked double", "append", GroupStateTimeout.NoTimeout)


def trust_updates(events: DataFrame, key: str, kind_col: str, order: str) -> DataFrame:
    """(key, trust) after each batch (R6): a failed scan 0.3, a good one adds 0.1 up to 1 or starts at 0.8, verification 1."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trust = state.get[0] if state.exists else None
        for what in pd.concat(list(parts)).sort_values(order)[kind_col]:
            trust = 1.0 if what == "verify" else 0.3 if what == "fail" else 0.8 if trust is None else min(1.0, trust + 0.1)
        state.update((trust,))
        yield pd.DataFrame({key: [k[0]], "trust": [round(trust, 6)]})

    return events.select(key, kind_col, order).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, trust double", "trust double", "update", GroupStateTimeout.NoTimeout)


def cache_steps(held: dict, events: list[tuple], ttl: float, size: int) -> list[bool]:
    """Whether each (time, key) is found in a cache, which ``held`` (key to time of entry, least recent first) carries on (R2).

    A key that isn't found, or is older than ``ttl``, enters anew; beyond ``size`` keys the least recent goes.
    """
    out = []
    for t, key in events:
        entered = held.pop(key, None)
        hit = entered is not None and t - entered <= ttl
        if entered is None and len(held) >= size:
            held.pop(next(iter(held)))
        held[key] = entered if hit else t
        out.append(hit)
    return out


def cache_hits(reads: DataFrame, cache: str, key: str, ts: str, order: str, ttl_s: float = 300.0, size: int = 1000, held: DataFrame | None = None) -> DataFrame:
    """(cache, order, hit, keys, entered): every read of a batch, found or not, and for each cache a row without ``hit`` of what it holds then (R2).

    ``held`` has such rows of what caches held before.  Nulls are a key of their own.  Spark sorts a cache's reads by time and
    a task follows them batch by batch, so it holds ``size`` keys however many reads there are.
    """
    kind, place = reads.schema[cache].dataType.simpleString(), reads.schema[order].dataType.simpleString()
    named = reads.select(
        F.col(cache).alias("cache_"), F.lit(1).alias("read_"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at_"), F.col(order).alias("order_"),
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("key_"), F.lit(None).cast("array<string>").alias("keys"), F.lit(None).cast("array<double>").alias("entered"),
    )
    if held is not None:
        named = named.unionByName(held.select(F.col(cache).alias("cache_"), F.lit(0).alias("read_"), "keys", "entered"), allowMissingColumns=True)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, began = None, {}, False

        def row(caches: list, orders: list, hits: list, keys: list, entered: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(caches, own_type), pa.array(orders, order_type), pa.array(hits, pa.bool_()), pa.array(keys, pa.list_(pa.string())), pa.array(entered, pa.list_(pa.float64()))], names=[cache, order, "hit", "keys", "entered"])

        for batch in batches:
            own_type, order_type = batch.schema.field("cache_").type, batch.schema.field("order_").type
            columns = {n: batch.column(n).to_pylist() for n in ("cache_", "read_", "at_", "order_", "key_")}
            at = 0
            while at < batch.num_rows:
                name, stop = columns["cache_"][at], at
                while stop < batch.num_rows and columns["cache_"][stop] == name:
                    stop += 1
                if began and name != own:
                    yield row([own], [None], [None], [list(state)], [list(state.values())])
                if not began or name != own:
                    own, state, began = name, {}, True
                if not columns["read_"][at]:
                    state = dict(zip(batch.column("keys")[at].as_py(), batch.column("entered")[at].as_py(), strict=True))
                    at += 1
                n = stop - at
                hits = cache_steps(state, list(zip(columns["at_"][at:stop], columns["key_"][at:stop], strict=True)), ttl_s, size)
                yield row([name] * n, columns["order_"][at:stop], hits, [None] * n, [None] * n)
                at = stop
        if began:
            yield row([own], [None], [None], [list(state)], [list(state.values())])

    sorted_reads = named.repartition("cache_").sortWithinPartitions("cache_", "read_", "at_", "order_")
    return sorted_reads.mapInArrow(step, f"{cache} {kind}, {order} {place}, hit boolean, keys array<string>, entered array<double>")


def replay(stream: DataFrame, out: str, cache: str, key: str, ts: str, order: str, ttl_s: float = 300.0, size: int = 1000):
    """Starts a stream whose every batch is followed by ``cache_hits`` and written to ``out`` under its number, with what the caches hold after it.

    A batch begins from the latest state of each cache before it and replaces what an earlier attempt at it wrote, so one
    that is repeated after a failure neither doubles a read nor counts it as seen.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{cache} {kinds[cache]}, {order} {kinds[order]}, hit boolean, keys array<string>, entered array<double>, batch long"

    def step(rows: DataFrame, batch: int) -> None:
        held = None
        if batch:
            states = rows.sparkSession.read.schema(schema).parquet(f"{out}/data").where(F.col("keys").isNotNull() & (F.col("batch") < batch))
            held = states.groupBy(cache).agg(F.max_by(F.struct("keys", "entered"), "batch").alias("s_")).select(cache, "s_.keys", "s_.entered")
        cache_hits(rows, cache, key, ts, order, ttl_s, size, held).write.mode("overwrite").parquet(f"{out}/data/batch={batch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start(), schema


def daily_counts(events: DataFrame, ts: str, kind: str, late: str = "1 day") -> DataFrame:
    """Events by day and kind (A4) with a watermark; the same plan runs on tables and on streams."""
    stamped = events.withColumn("at_", F.col(ts).cast("timestamp"))
    stamped = stamped.withWatermark("at_", late)
    return stamped.groupBy(F.window("at_", "1 day").alias("w_"), kind).agg(F.count("*").alias("n")).select(F.col("w_.start").alias("day"), kind, "n")


def session_batches(events: DataFrame, key: str, ts: str, gap: str = "100 milliseconds", late: str = "1 minute") -> DataFrame:
    """Requests of a key that follow each other within the gap."""
    stamped = events.withColumn("at_", F.col(ts).cast("timestamp")).withWatermark("at_", late)
    return stamped.groupBy(F.session_window("at_", gap).alias("w_"), key).agg(F.count("*").alias("n")).select(key, F.col("w_.start").alias("first_ts"), "n")


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that a stream has available, as a table in memory; for tests and small reports."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def file_stream(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
