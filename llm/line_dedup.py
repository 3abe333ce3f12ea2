"""Repeated lines across documents, by two Bloom filters and an exact count of the suspects.

A first pass over the texts sends 64-bit hashes of line keys, distinct within a stretch of text, to the shard of the
filters that they belong to.  A shard enters each hash into a filter of hashes seen once and, where it was there before,
into a filter of hashes seen twice.  Only the second is kept; the filters of all shards together have at most
``FILTER_BITS`` bits, which is what is broadcast.  A second pass tests every line: only suspects, lines that some
other document may hold too, are shuffled, by 128-bit hashes, for the exact count of documents and the choice of the
first occurrence.  A full filter costs shuffled rows, never a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mix, partitions, salted_join, small_batches, table, text_bytes, trim

#: Bits of the twice-seen filters of all shards, at most: 64 MB.
FILTER_BITS = 1 << 29
#: Bits a line of the filters, probes a hash, lines of a shard, and text of a stretch.
ONCE_BITS, TWICE_BITS, PROBES, SHARD_LINES, STRETCH = 12, 2, 4, 1 << 21, 32 << 20
MASK = np.uint64(0xFFFFFFFF)


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of each line: white space stripped at both ends, A-Z lower-cased."""
    return [line.strip() for line in (text or b"").lower().split(b"\n")]


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of hashes in a filter: one row a probe."""
    low, high = hashes & MASK, hashes >> np.uint64(32) | np.uint64(1)
    return np.array([(low + np.uint64(k) * high) % np.uint64(bits) for k in range(PROBES)]).astype(np.int64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(hashes) >> np.uint64(33)) * np.uint64(shards) >> np.uint64(31)).astype(np.int64)


def twice_filter(blocks: list[np.ndarray], repeated: list[np.ndarray], bits: int) -> np.ndarray:
    """Packed bits of the hashes that two blocks hold, or that are marked as repeated within one.

    ``blocks`` hold distinct hashes each.
    """
    once = np.zeros(max(64, sum(map(len, blocks)) * ONCE_BITS), bool)
    twice = np.zeros(bits, bool)
    for hashes, again in zip(blocks, repeated, strict=True):
        at = probes(hashes, len(once))
        twice[probes(hashes[once[at].all(axis=0) | again], bits)] = True
        once[at] = True
    return np.packbits(twice, bitorder="little")


def in_filter(packed: np.ndarray, hashes: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Which hashes the shards' filters, ``bits`` long each and one after the other, may hold."""
    at = probes(hashes, bits) + shard_of(hashes, shards) * bits
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)


def line_hashes(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, hashes, again): distinct key hashes of each stretch of text, and which of them several of its documents hold."""

    def run(batches):
        found: list[np.ndarray] = []
        size = 0

        def flush():
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            shard = shard_of(values, shards)
            order = np.argsort(shard, kind="stable")
            values, again, shard = values[order], (counts > 1)[order], shard[order]
            own, first = np.unique(shard, return_index=True)
            ends = [*first[1:].tolist(), len(shard)]
            return pa.RecordBatch.from_arrays([
                pa.array(own.astype(np.int32)), pa.array([values[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()),
                pa.array([again[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()),
            ], names=["shard", "hashes", "again"])

        for batch in chunks(batches, "text"):
            for text in text_bytes(batch.column("text")):
                if text:
                    keys = set(line_keys(text))
                    keys.discard(b"")
                    found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                    size += len(text)
            if size > STRETCH:
                yield flush()
                found, size = [], 0
        if found:
            yield flush()
        trim()

    return small_batches(docs).select("text").mapInArrow(run, "shard int, hashes binary, again binary")


def shard_filters(hashes: DataFrame, bits: int) -> DataFrame:
    """(shard, bits): the twice-seen filter of every shard, from its blocks in any order."""

    def run(rows: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        again = [np.frombuffer(x, bool) for x in rows.column("again").to_pylist()]
        return pa.table({"shard": rows.column("shard").slice(0, 1), "bits": pa.array([twice_filter(blocks, again, bits).tobytes()], pa.binary())})

    return hashes.groupBy("shard").applyInArrow(run, "shard int, bits binary")


def suspects(keyed: DataFrame, packed, shards: int, bits: int) -> DataFrame:
    """(row, doc_id, line): 128-bit hashes of the lines of ``keyed`` that the twice-seen filters may hold, distinct in a row."""

    def run(batches):
        filters = np.frombuffer(packed.value, np.uint8)
        for batch in chunks(batches, "text"):
            keys: list[bytes] = []
            counts = []
            for text in text_bytes(batch.column("text")):
                own = set(line_keys(text))
                own.discard(b"")
                keys += own
                counts.append(len(own))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            hit = np.nonzero(in_filter(filters, hashes, shards, bits))[0]
            holder = pa.array(np.repeat(np.arange(len(counts)), counts)[hit])
            lines = pa.array([xxhash.xxh3_128_digest(keys[i]) for i in hit.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(holder), batch.column("doc_id").take(holder), lines], names=["row", "doc_id", "line"])

    return keyed.mapInArrow(run, "row long, doc_id long, line binary")


def drop_repeated_lines(docs: DataFrame, least: int = 2, keep_first: bool = False, shard_lines: int = SHARD_LINES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row, without the lines that ``least`` or more rows hold.

    Lines are compared by key (see ``line_keys``); lines with an empty key always stay.  With ``keep_first`` the
    first line of its key stays in the row that comes first by doc_id (nulls first), and, among rows of one id, by a
    hash of id and text.  A null text is an empty one, which is one empty line.  Repeated rows count as a row each,
    and where one of several equal rows keeps a first line, all do.  A line repeated within one row only isn't
    repeated.  Only doc_id and text are read, whatever the other columns; no rows give no rows.
    """
    if least < 2:
        raise ValueError("a line that one row holds isn't repeated: least must be 2 or more")
    own = F.col("doc_id").cast("long")
    keyed = small_batches(docs).select(own.alias("doc_id"), "text", F.xxhash64(own, "text").alias("row"))
    lines = docs.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    shards = max(2 * partitions(docs), -(-int(lines) // shard_lines))
    bits = 8 * -(-min(FILTER_BITS, max(TWICE_BITS * int(lines), 1 << 16)) // (8 * shards))
    packed = bytearray(shards * bits // 8)
    for shard, own_bits in shard_filters(line_hashes(docs, shards), bits).collect():
        packed[shard * bits // 8 : (shard + 1) * bits // 8] = own_bits
    found = suspects(keyed, docs.sparkSession.sparkContext.broadcast(bytes(packed)), shards, bits)
    repeated = found.groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row")).alias("first")).where(F.col("n") >= least)
    gone = salted_join(found, repeated.select(F.col("line").alias("same"), F.col("first.row").alias("first_row")), "line", "same")
    spared = F.when(F.lit(keep_first) & (F.col("row") == F.col("first_row")), F.col("line"))
    gone = gone.groupBy(F.col("row").alias("of")).agg(F.collect_set("line").alias("gone"), F.collect_set(spared).alias("spared"))
    joined = keyed.join(gone, F.col("row") == F.col("of"), "left").select("doc_id", "text", "gone", "spared")

    def run(batches):
        for batch in chunks(batches, "text"):
            totals, dropped, kept = [], [], []
            for text, out, first in zip(text_bytes(batch.column("text")), batch.column("gone").to_pylist(), batch.column("spared").to_pylist(), strict=True):
                text = text or b""
                if out:
                    out, first, whole, stay = set(out), set(first), text.split(b"\n"), []
                    for line, key in zip(whole, line_keys(text), strict=True):
                        mark = xxhash.xxh3_128_digest(key) if key else None
                        if mark not in out:
                            stay.append(line)
                        elif mark in first:
                            first.discard(mark)
                            stay.append(line)
                    totals.append(len(whole))
                    dropped.append(len(whole) - len(stay))
                    kept.append(b"\n".join(stay))
                else:
                    totals.append(text.count(b"\n") + 1)
                    dropped.append(0)
                    kept.append(text)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())
            ], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"), least=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
),
gone AS (SELECT key AS gone_key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone_key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone_key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN gone ON key = gone_key GROUP BY r, doc_id
"""
