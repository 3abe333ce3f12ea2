"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step handles at a time, so that memory stays bounded whatever the batch.
CHUNK_BYTES = 2 << 20


#: Bytes of a record batch between Spark and its Python workers: a few texts at a time, however long they are.
BATCH = "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, with the session told to hand Python small record batches; without it a task holds 64 MB or more at once."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="shared-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark then removes the files of shuffles that nothing refers to, which else lie there until memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text whose hashes one bucket gathers, about.
BUCKET_BYTES = 32 << 20


def buckets_for(docs: DataFrame, text_col: str = "text") -> int:
    """Buckets by hash of what a table's texts give: a fixed share of the bytes each, so that no task grows with the input."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(2 * partitions(docs), -(-int(size) // BUCKET_BYTES))


def split_of(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``: the split between training and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def chunks(batches, column: str, limit: int = CHUNK_BYTES):
    """Slices of record batches, each with about ``limit`` bytes of text or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def trim() -> None:
    """Gives freed memory back to the system, where the C library can; Python workers live on after their tasks."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def per_process(key, make):
    """What ``make`` returns, made once in a Python worker and kept for its later tasks, until another is asked for."""
    kept = sys.__dict__.setdefault("_per_process", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def release() -> None:
    """Forgets what a Python worker keeps for later tasks, and gives its memory back."""
    kept = sys.__dict__.get("_per_process")
    if kept:
        kept.clear()
        trim()


class WordHashes(dict):
    """64-bit hashes of byte strings; forgets all when it holds ``limit`` entries."""

    def __init__(self, seed: int = 0, limit: int = 150_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words looked up at a time: few enough to stay in the processor's cache.
CACHED_WORDS = 40_000


def hashed_words(texts: list[bytes | None], hashes: dict, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and the number of words of each text."""
    words: list[bytes] = []
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)

    def flush() -> None:
        found.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        words.clear()

    for i, text in enumerate(texts):
        if text:
            own = (text.lower() if lower else text).split()
            counts[i] = len(own)
            words += own
            if len(words) > CACHED_WORDS:
                flush()
    flush()
    return np.concatenate(found), counts


#: Bits of a filter of hashes: for each hash, and at most (16 MB).
FILTER_SHARE, FILTER_BITS = 16, 1 << 27


def hash_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """Words of 64 bits with a bit set for every hash in ``column`` (long)."""
    bits = min(FILTER_BITS, 1 << max(12, (FILTER_SHARE * hashes.count()).bit_length()))
    own = F.col(column)
    found = hashes.groupBy(F.shiftright(own.bitwiseAND(bits - 1), 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({column} & 63L AS int)))").alias("word")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return words


def let_through(rows: DataFrame, column: str, words: np.ndarray) -> DataFrame:
    """The rows whose hash in ``column`` a filter holds, and a few others: what a join would drop isn't shuffled."""

    def run(batches):
        for batch in batches:
            slot = batch.column(column).to_numpy().view(np.uint64) & np.uint64((len(words) << 6) - 1)
            yield batch.filter(pa.array((words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)))

    return rows.mapInArrow(run, rows.schema)


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, lookup_key: str, salts: int = 16) -> DataFrame:
    """Inner join of ``rows`` to a lookup with one row per key; a key that most rows share is spread over ``salts`` tasks.

    The salt is a hash of the row, so a task that runs again deals every row as before.
    """
    left = rows.withColumn("salt_", F.pmod(F.xxhash64(F.lit(29), *rows.columns), F.lit(salts)).cast("int"))
    right = lookup.withColumn("other_salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, (F.col(key) == F.col(lookup_key)) & (F.col("salt_") == F.col("other_salt_"))).drop("salt_", "other_salt_")


def with_least(edges: DataFrame, n_edges: int) -> DataFrame:
    """(u, v, m): every edge with the least neighbour of u.

    Nodes with more than a thousandth of all edges, which are a thousand at most, are looked up by broadcast,
    so that no task gathers the edges of a hub; all others are joined.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    limit = max(1000, n_edges // 1000)
    hubs = least.where(F.col("degree") > limit).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    marked = edges.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    rest = marked.where("hub IS NULL").select("u", "v").join(least.where(F.col("degree") <= limit).select("u", "m"), "u")
    return marked.where("hub IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")).unionByName(rest)


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and for each the least node that these edges connect it with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    labels = np.arange(len(nodes))
    while True:
        before = labels.copy()
        low = np.minimum(labels[left], labels[right])
        np.minimum.at(labels, left, low)
        np.minimum.at(labels, right, low)
        labels = labels[labels]
        if (labels == before).all():
            return nodes, nodes[labels]


def contracted(batches):
    """A partition of edges (a, b) as edges (u, v) from its nodes to the least node they are connected with in it."""
    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if pairs:
        nodes, least = least_labels(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        moved = nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(least[moved])], names=["u", "v"])


#: Edges that one task contracts at a time.
EDGES = 200_000


def components(edges: DataFrame, task_edges: int = EDGES, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b long) as (node, root), root being the least id.

    Edges are gathered into partitions of about ``task_edges``, and each is contracted: its nodes then point
    at the least node they are connected with there.  A graph that fits one such partition is done.  A larger
    one goes through alternating large-star and small-star steps in between, until nothing changes: minima
    are aggregated per node before the shuffle and joined back, those of hubs by broadcast (see
    ``with_least``).  Lineage is cut with a checkpoint after each step; only counts and one checksum reach
    the driver.
    """
    edges = cut(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        n = edges.count()
        parts = max(1, -(-n // task_edges))
        small = edges.coalesce(parts).mapInArrow(contracted, "u long, v long")
        if parts == 1:
            edges = cut(small)
            break
        edges = cut(small)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(with_least(large, n).select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # Every node but a root now points at its root.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
