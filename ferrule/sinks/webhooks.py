"""Signed messages to webhooks, from tables and from streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Bytes of a block of the hash, and what its key is combined with.
BLOCK, INNER, OUTER = 64, 0x36, 0x5C


def padded_key(secret: Column, byte: int) -> Column:
    """A key of at most a block's bytes (a longer one is hashed first), filled with zeros, each byte combined with ``byte``."""
    raw = secret.cast("binary")
    digits = F.rpad(F.when(F.octet_length(raw) > BLOCK, F.sha2(raw, 256)).otherwise(F.hex(raw)), 2 * BLOCK, "0")
    one = lambda i: F.lpad(F.hex(F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(byte))), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(BLOCK)), one), ""))


def signed(message: Column, inner: Column, outer: Column) -> Column:
    """HMAC-SHA-256 in lowercase hex of a message under a key that is padded both ways already."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def hmac_sha256(message: Column, secret: Column) -> Column:
    """HMAC-SHA-256 in lowercase hex, by built-in functions."""
    return signed(message, padded_key(secret, INNER), padded_key(secret, OUTER))


def messages(events: DataFrame, hooks: DataFrame, org: str = "org", event: str = "event", payload: str = "payload", at: str = "at", key: str = "event_id") -> DataFrame:
    """(delivery_id, hook_id, url, body, signature) of every event for each enabled hook of its organisation that listens to it.

    ``hooks`` has hook_id, org, url, secret, events (array) and enabled.  The body is the event, its payload (JSON text) and
    its time as JSON; a delivery's id is that of hook and event, so a receiver can tell a repetition.
    """
    # Keys are padded once a hook, on its side of the join; for every message that took most of the time.
    padded = hooks.where("enabled").select("hook_id", F.col("org").alias("org_"), "url", F.array_distinct("events").alias("events_"), padded_key(F.col("secret"), INNER).alias("inner_"), padded_key(F.col("secret"), OUTER).alias("outer_"))
    listening = padded.select("hook_id", "org_", "url", "inner_", "outer_", F.explode("events_").alias("event_"))
    joined = events.join(listening, (F.col(org) == F.col("org_")) & (F.col(event) == F.col("event_")))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col(event).cast("string").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    body = F.concat(F.lit('{"event":'), quoted, F.lit(',"payload":'), F.col(payload), F.lit(',"timestamp":"'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"}'))
    made = joined.select("hook_id", "url", "inner_", "outer_", F.sha2(F.concat_ws(":", F.col("hook_id").cast("string"), F.col(key).cast("string")), 256).alias("delivery_id"), body.alias("body"))
    return made.select("delivery_id", "hook_id", "url", "body", signed(F.col("body"), F.col("inner_"), F.col("outer_")).alias("signature"))


def is_sent(spark: SparkSession, ledger: str, batch: int) -> bool:
    """Whether the ledger has the batch; it is written after the last message went out."""
    try:
        return bool(spark.read.parquet(f"{ledger}/batch={batch}").limit(1).collect())
    except AnalysisException:
        return False


def deliver(stream: DataFrame, hooks: DataFrame, send: Callable[[Iterator[Row]], None], ledger: str, checkpoint: str, **names: str):
    """Starts a stream that hands every batch's messages to ``send``, partition by partition, on the executors.

    A batch that the ledger has is not sent again when the stream repeats it, as it does after a failure between the
    batch and its commit.  If sending itself fails the batch is repeated as a whole, with the same delivery ids.
    """

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if not is_sent(spark, ledger, batch):
            messages(rows, hooks, **names).foreachPartition(send)
            spark.range(1).select(F.current_timestamp().alias("sent_at")).write.mode("overwrite").parquet(f"{ledger}/batch={batch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
