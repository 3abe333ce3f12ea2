"""Quality by nearest-neighbour voting in a latent semantic space.

Texts become frequencies of hashed word shapes, words and repetitions; a truncated singular value
decomposition of a bounded sample of labelled rows gives the latent axes.  The sample's vectors are
broadcast; every document's cosines with all of them are computed exactly, block by block, and the nearest
vote by similarity.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, small_batches, split_of, table, text_bytes
from .training import labelled, sample

THRESHOLD = 0.7
SHAPES, WORDS = 1024, 1024
WIDTH = SHAPES + WORDS + 8
#: Labelled rows of each class that are broadcast, latent axes, and neighbours that vote.
PER_CLASS, AXES, NEIGHBOURS = 1500, 48, 15
RUNS = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"(?:[a-z]|[\x80-\xff])+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^A-Za-z0-9])\1+"), rb"\1+")]


def shape(word: bytes) -> bytes:
    """Runs of capitals, other letters and digits as one sign each, repeated marks as a mark and a plus."""
    for pattern, sign in RUNS:
        word = pattern.sub(sign, word)
    return word


class WordCodes(dict):
    """Of each word: bucket of its shape and bucket of its lower-cased letters, packed into one integer."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(shape(word)) % SHAPES << 48 | xxhash.xxh3_64_intdigest(word.lower()) & (1 << 48) - 1
        return value


def frequencies(texts: list[bytes | None], known: WordCodes) -> np.ndarray:
    """Rows of unit length: square roots of shares of shapes, words, repeated neighbours, new words, lengths."""
    words, counts, lines = [], np.ones(len(texts), np.int64), np.zeros(len(texts))
    for i, text in enumerate(texts):
        own = (text or b"").split() or [b""]
        counts[i] = len(own)
        words += own
        rows = (text or b"").split(b"\n")
        lines[i] = 1 - len(set(rows)) / len(rows)
    codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(texts)), counts)
    n = counts.astype(np.float64)
    out = np.zeros((len(texts), WIDTH))
    out[:, :SHAPES] = np.bincount(owner * SHAPES + (codes >> 48), minlength=len(texts) * SHAPES).reshape(-1, SHAPES) / n[:, None]
    out[:, SHAPES : SHAPES + WORDS] = 0.15 * np.bincount(owner * WORDS + codes % WORDS, minlength=len(texts) * WORDS).reshape(-1, WORDS) / n[:, None]
    same = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.array([len(np.unique(c)) for c in np.split(codes, np.cumsum(counts)[:-1])])
    out[:, -8] = np.bincount(owner[1:][same], minlength=len(texts)) / n
    out[:, -7] = 0.3 * (1 - distinct / n)
    out[:, -6] = 0.3 * lines
    out[:, -5] = 0.3 / n
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1e-12)).astype(np.float32)


def latent_axes(x: np.ndarray, axes: int = AXES, seed: int = 1) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration."""
    draw = np.random.default_rng(seed)
    q = np.linalg.qr(draw.normal(size=(x.shape[1], min(axes + 8, *x.shape))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    u, s, _ = np.linalg.svd(q.T @ (x.T @ (x @ q)))
    return (q @ u[:, :axes]).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(texts: list[str], y: np.ndarray, shares: dict[int, float]) -> dict:
    """Axes, labelled vectors, and votes; ``shares`` are the classes' shares before sampling."""
    y = np.asarray(y, np.int64)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 1.0}
    known = WordCodes()
    x = np.concatenate([frequencies([t.encode() for t in texts[i : i + 500]], known) for i in range(0, len(texts), 500)])
    axes = latent_axes(x)
    votes = np.array([shares[int(k)] / max(1, (y == k).sum()) for k in y])
    return {"axes": axes, "vectors": unit(x @ axes), "y": y.astype(np.float64), "votes": votes / votes.mean()}


def probabilities(model: dict, texts: list[bytes | None], known: WordCodes, neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
    """Shares of votes for label 1 among the nearest labelled vectors; a vote weighs as its similarity to the 20th power.

    Texts are taken ``block`` at a time, so memory is bounded however many short or empty ones there are.
    """
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    out = np.empty(len(texts))
    k = min(neighbours, len(model["y"]))
    for at in range(0, len(texts), block):
        cosine = unit(frequencies(texts[at : at + block], known) @ model["axes"]) @ model["vectors"].T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3) ** 20 * model["votes"][near]
        out[at : at + block] = (weight * model["y"][near]).sum(1) / weight.sum(1)
    return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, condition, label: str = "quality", per_class: int = PER_CLASS) -> dict:
    rows, counts = sample(docs, labelled(docs, labels, label, condition), per_class)
    good = (rows["y"] == "1").to_numpy().astype(int)
    ones = counts.get("1", 0)
    rest = sum(counts.values()) - ones
    return fit(rows["text"].tolist(), good, {1: ones / max(1, ones + rest), 0: rest / max(1, ones + rest)})


def with_score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs``, all columns, with a score of every whole text; null texts are scored as empty ones, equal texts get equal scores.

    Without labelled rows of both classes the score is the share of label 1 (1 without any).
    Only ``text`` is read; a column that is called ``name`` already is replaced.  Repeated rows are scored each
    for itself, rows with a null doc_id like any others; of neighbours at equal cosine any may vote.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)

    def run(batches):
        known = WordCodes()
        for batch in chunks(batches, "text", 1 << 20):
            found = probabilities(shared.value, text_bytes(batch.column("text")), known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = split_of("doc_id", 4) == 2
    model = train(docs, table(spark, sf_dir, "labels"), ~held)
    return with_score(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
