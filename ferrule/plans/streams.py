"""Queries that run as streams over the event table, and their batch equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import query, table
from ..session import shared_folder
from ..sinks import webhooks
from ..streaming import processors, state


def stream_of(spark, d, *columns, files_per_batch: int | None = None):
    """The event table as a stream of files: a file of that name, or all files of a folder of that name."""
    schema = table(spark, d, "events").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A stream reads folders; the pattern matches the one file or the folder alike.
    return reader.parquet(f"{d}/events.parque[t]").select(*columns)


def folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def written(spark, stream, mode: str, key: str | None = None):
    """What the stream has written when all is read, from a folder that the cluster shares.

    In update mode every batch's changes are kept under its number, and the last of each ``key`` counts.
    """
    out = folder(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{out}/check").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{out}/data").start()
    elif mode == "complete":
        q = writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/data")).start()
    else:
        q = writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/data/batch={n}")).start()
    q.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{out}/data")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{out}/data")
    others = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("last_")).select(key, *[f"last_.{c}" for c in others])


@query("daily_trend", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def daily_trend(spark, d):
    """The plan of the stream, on the table."""
    return state.daily_counts(table(spark, d, "events").select("ts", "event_type"), "ts", "event_type")


@query("stream_daily_trend", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_daily_trend(spark, d):
    """The same counts from a stream with a watermark."""
    return written(spark, state.daily_counts(stream_of(spark, d, "ts", "event_type"), "ts", "event_type"), "complete")


@query("stream_rate_limit")
def stream_rate_limit(spark, d):
    """Each event let through or refused by the limiter."""
    return written(spark, state.rate_limit(stream_of(spark, d, "user_id", "ts", "event_id"), "user_id", "ts", "event_id", 86_400.0, 3), "append")


TRUST = "CASE WHEN event_type = 'purchase' THEN 'verify' WHEN event_type = 'error' OR value > 80 THEN 'fail' ELSE 'ok' END"


@query("stream_trust", f"""
WITH e AS (SELECT user_id, {TRUST} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
l AS (SELECT user_id, max(CASE WHEN kind <> 'ok' THEN n END) AS last_set, count(*) AS c FROM e GROUP BY user_id)
SELECT l.user_id, round(least(1.0, CASE WHEN last_set IS NULL THEN 0.8 WHEN e.kind = 'verify' THEN 1.0 ELSE 0.3 END + 0.1 * (c - coalesce(last_set, 1)))::DOUBLE, 6) AS trust FROM l LEFT JOIN e ON e.user_id = l.user_id AND e.n = l.last_set""")
def stream_trust(spark, d):
    """Trust folded over the stream."""
    rows = stream_of(spark, d, "user_id", "event_type", "value", "event_id").select("user_id", F.expr(TRUST).alias("kind"), "event_id")
    return written(spark, state.trust_updates(rows, "user_id", "kind", "event_id"), "update", "user_id")


@query("stream_cache_hits")
def stream_cache_hits(spark, d):
    """Each read found or not in a cache of the twenty latest users a kind of event (R2); tests hold it against a plain replay."""
    out = folder(spark)
    q, schema = state.replay(stream_of(spark, d, "event_type", "user_id", "ts", "event_id"), out, "event_type", "user_id", "ts", "event_id", 86_400.0, 20)
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/data").where("hit IS NOT NULL").select("event_type", "event_id", "hit")


@query("stream_ring", """
SELECT user_id::VARCHAR AS user_id, count(*)::BIGINT AS kept, min(event_id) AS oldest, max(event_id) AS newest, arg_max(event_type, event_id) AS last_value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 20 GROUP BY user_id""")
def stream_ring(spark, d):
    """The latest twenty events of each user, kept as list state over the stream."""
    rows = stream_of(spark, d, "user_id", "event_id", "event_type")
    with processors.with_rocksdb(spark):
        found = written(spark, processors.ring(rows, "user_id", "event_id", "event_type", 20), "update", "key")
    return found.withColumnRenamed("key", "user_id")


@query("stream_schedules", """
WITH c AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_type = 'signup' AS enabled, (1 + user_id % 5) * 21600000 AS every, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS next_at
  FROM events WHERE event_type IN ('signup', 'error')),
w AS (SELECT epoch_us(max(ts)) // 1000 - 86400000 AS watermark FROM events WHERE event_type IN ('signup', 'error'))
SELECT user_id::VARCHAR AS user_id, make_timestamp(due * 1000) AS due
FROM (SELECT user_id, unnest(generate_series(t + every, coalesce(next_at - 1, watermark), every)) AS due FROM c, w WHERE enabled)""")
def stream_schedules(spark, d):
    """Sign-ups start a user's schedule and errors end it; every time due, once each, by timers."""
    rows = stream_of(spark, d, "user_id", "event_id", "ts", "event_type").where("event_type IN ('signup', 'error')")
    changes = rows.select("user_id", "event_id", "ts", ((1 + F.col("user_id") % 5) * 21_600).alias("every_s"), (F.col("event_type") == "signup").alias("enabled"))
    with processors.with_rocksdb(spark):
        found = written(spark, processors.due_schedules(changes, "user_id", "ts", "event_id", "every_s", "enabled", late="1 day"), "append")
    return found.withColumnRenamed("key", "user_id")


HOOKS = "(SELECT n_nationkey AS hook_id, n_regionkey AS org, 'https://hooks.example/' || n_name AS url, 'secret-' || n_name AS secret, CASE n_nationkey % 3 WHEN 0 THEN ['click', 'error'] WHEN 1 THEN ['purchase'] ELSE ['error', 'view'] END AS events, n_nationkey % 4 <> 3 AS enabled FROM nation)"


def pad_sql(byte: int) -> str:
    return f"list_aggregate(list_transform(range(1, 65), lambda i: chr(xor(CASE WHEN i <= length(secret) THEN ascii(substr(secret, i, 1)) ELSE 0 END, {byte}))), 'string_agg', '')"


@query("webhook_messages", f"""
WITH m AS (SELECT event_id, hook_id, secret, '{{"event":"' || event_type || '","payload":' || props || ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}}' AS body
  FROM (SELECT *, user_id % 5 AS org FROM events) e JOIN {HOOKS} h ON e.org = h.org AND list_contains(h.events, e.event_type) AND h.enabled)
SELECT hook_id, body, sha256(hook_id || ':' || event_id) AS delivery_id, sha256(encode({pad_sql(0x5C)}) || unhex(sha256(encode({pad_sql(0x36)}) || encode(body)))) AS signature FROM m""")
def webhook_messages(spark, d):
    """Signed messages to the hooks that listen."""
    table(spark, d, "nation").createOrReplaceTempView("ferrule_nation")
    hooks = spark.sql("SELECT * FROM " + HOOKS.replace("FROM nation", "FROM ferrule_nation").replace("['", "array('").replace("']", "')"))
    events = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("org"), F.col("event_type").alias("event"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("at"))
    return webhooks.messages(events, hooks).select("hook_id", "body", "delivery_id", "signature")
