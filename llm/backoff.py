"""Stupid-backoff scores by relational joins.

Documents are dealt by hash into batches of bounded size.  Every batch sends its distinct n-grams and their
counts to buckets by hash; a bucket adds up the counts of all batches, which is the n-gram count table
partitioned by hash, and answers each batch in the order in which it asked.  A batch then joins the answers
to its exploded n-grams and sums log scores per document.  Orders above two ask only for n-grams whose two
shorter parts reach the least count, since no other can.  N-grams travel in packed, sorted byte blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BUCKET_BYTES, mix, partitions, table

ORDER, LEAST, FACTOR = 3, 2, 0.4
BATCH_BYTES = 8 << 20
#: The bits of an n-gram's hash that are known besides its bucket.
REST = (1 << 40) - 1
ASK = "bucket int, batch int, n int, rest binary, counts binary"
ANSWER = "batch int, bucket int, n int, counts binary, tokens long"


def pack_counts(x: np.ndarray) -> bytes:
    """Counts as bytes; 255 stands for a larger one, which follows after the bytes as a 64-bit integer."""
    return np.minimum(x, 255).astype("u1").tobytes() + x[x >= 255].astype("<i8").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    small = np.frombuffer(blob, "u1", n).astype(np.int64)
    small[small == 255] = np.frombuffer(blob, "<i8", offset=n)
    return small


def pack_rests(x: np.ndarray) -> bytes:
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32) & np.uint64(0xFF)).astype("u1").tobytes()


def unpack_rests(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return np.frombuffer(blob, "<u4", n).astype(np.uint64) | np.frombuffer(blob, "u1", n, 4 * n).astype(np.uint64) << np.uint64(32)


def ngrams(h: np.ndarray, counts: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per order 1..order: hash of the n-gram that ends at each word, and whether it lies in one text."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams, inside = [mix(h)], [np.ones(len(h), bool)]
    for n in range(2, order + 1):
        longer = grams[-1].copy()
        longer[1:] = mix(grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(2 * n + 1))
        grams.append(longer)
        inside.append(place >= n - 1)
    return grams, inside


def keys_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """N-grams as keys that sort by bucket, then by the 40 bits known of the rest."""
    return grams % np.uint64(buckets) << np.uint64(40) | grams // np.uint64(buckets) & np.uint64(REST)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's stretch of sorted keys begins, and the end."""
    return np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << np.uint64(40)).tolist() + [len(keys)]


#: Bytes inside words, bytes of words in lower case, and masks that keep the first bytes of eight.
INSIDE = np.ones(256, bool)
INSIDE[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of text whose words are hashed at a time: few enough to stay in the processor's cache.
STRETCH = 1 << 18


def stretch_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and counts of texts that lie one after the other in ``data``, between ``bounds``.

    Words are read eight bytes at a time, all words at once, each step mixed into what came before; words of one length up
    to eight never share a hash.
    """
    word = INSIDE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = bounds[bounds < len(data)]
    begins[edge] = word[edge]
    edge = bounds[bounds > 0] - 1
    ends[edge] = word[edge]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    padded = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    h = mix(size.astype(np.uint64))
    own, at = np.arange(len(start)), 0
    while len(own):
        part = eights[start[own] + at] & FIRST_BYTES[np.minimum(size[own] - at, 8)]
        h[own] = mix(h[own] * np.uint64(0x9E3779B97F4A7C15) ^ part)
        at += 8
        own = own[size[own] > at]
    return h, np.diff(np.searchsorted(start, bounds))


def batch_words(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and counts of a batch's texts, in the order of its rows."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for column in docs.column("text").chunks:
        texts = column.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + STRETCH, side="right")) - 1)
            h, n = stretch_words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            hashes.append(h)
            counts.append(n)
            i = j
    return np.concatenate(hashes), np.concatenate(counts)


def asks(batch: int, n: int, grams: np.ndarray, mask: np.ndarray, buckets: int) -> list[tuple]:
    if not mask.any():
        return []
    keys, counts = np.unique(keys_of(grams[mask], buckets), return_counts=True)
    edges = bucket_edges(keys, buckets)
    rest = keys & np.uint64(REST)
    return [(b, batch, n, pack_rests(rest[i:j]), pack_counts(counts[i:j])) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i]


def answered(answers: pa.Table, grams: list[np.ndarray], inside: list[np.ndarray], buckets: int, least: int, order: int, first: int = 1) -> tuple[list[np.ndarray], int]:
    """Corpus counts at each position of the orders answered so far, 0 below the least count, and the corpus's number of words.

    Orders below ``first``, at most 2, are passed over; they tell nothing about which longer ones were asked for.
    """
    rows: dict[int, dict[int, bytes]] = {}
    words: dict[int, int] = {}
    for r in answers.select(["bucket", "n", "counts", "tokens"]).to_pylist():
        rows.setdefault(r["n"], {})[r["bucket"]] = r["counts"]
        if r["n"] == 1:
            words[r["bucket"]] = r["tokens"]
    found: list[np.ndarray] = []
    for n in range(1, order + 1):
        if n < first:
            found.append(np.zeros(0, np.int64))
            continue
        mask = inside[n - 1] if n <= 2 else inside[n - 1] & parts_frequent(found, n)
        value = np.zeros(len(mask), np.int64)
        if mask.any():
            keys, at = np.unique(keys_of(grams[n - 1][mask], buckets), return_inverse=True)
            edges = bucket_edges(keys, buckets)
            total = np.concatenate([unpack_counts(rows[n][b], j - i) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i])
            value[mask] = total[at]
            if n > 1:
                value[value < least] = 0
        found.append(value)
    return found, sum(words.values())


def parts_frequent(found: list[np.ndarray], n: int) -> np.ndarray:
    """Where both (n - 1)-grams of the n-gram that ends here were kept."""
    last = found[n - 2] > 0
    return last & np.append(False, last[:-1])


def position_scores(found: list[np.ndarray], words: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Log score and order used at each position: the longest kept n-gram's count over its context's, times the factor per step down."""
    order = len(found)
    score, used = np.zeros(len(found[0])), np.zeros(len(found[0]), np.int64)
    for n in range(order, 0, -1):
        own = (used == 0) & (found[n - 1] > 0)
        before = np.append(1, found[n - 2][:-1]) if n > 1 else np.full(len(own), words)
        score[own] = np.log(found[n - 1][own] / before[own]) + (order - n) * math.log(factor)
        used[own] = n
    return score, used


def score_documents(docs: DataFrame, order: int = ORDER, least: int = LEAST, factor: float = FACTOR, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, orders) for every row of ``docs`` (doc_id, text).

    The model is the corpus itself: counts of word n-grams over all rows, words separated by ASCII white
    space and A-Z lower-cased; n-grams of two or more words that occur fewer than ``least`` times are left
    out.  ``orders`` counts the words scored by each order.  Null, empty and blank texts have no words and
    score 0.  Repeated rows count each time and get equal scores; null ids and extra columns do no harm.
    An n-gram is known by its bucket and 40 further bits of its hash.  A bucket holds a fixed share of the text,
    however much there is, so the chance that an n-gram shares its key with another stays about one in 10^5.
    Of equal scores of a word at several orders the longest order's counts.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    batches = max(1, -(-int(total["b"] or 0) // batch_bytes), int(total["n"]) // 200_000)
    buckets = max(2 * partitions(docs), -(-int(total["b"] or 0) // BUCKET_BYTES))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    wordless = docs.where(blank).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log_score"), F.lit(0.0).alias("mean_log_score"), F.array(*[F.lit(0).cast("long")] * order).alias("orders")
    )
    docs = docs.where(~blank)  # the others would all be dealt to one batch
    dealt = docs.select(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(batches)).cast("int").alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def asked(out: list[tuple]) -> pa.Table:
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "batch", "n", "rest", "counts"])

    def ask_short(part: pa.Table) -> pa.Table:
        batch = part.column("batch")[0].as_py()
        grams, inside = ngrams(*batch_words(part), min(order, 2))
        return asked([row for n in range(1, min(order, 2) + 1) for row in asks(batch, n, grams[n - 1], inside[n - 1], buckets)])

    def ask_longer(n: int):
        def run(part: pa.Table, answers: pa.Table) -> pa.Table:
            if not part.num_rows:
                return asked([])
            grams, inside = ngrams(*batch_words(part), n)
            found, _ = answered(answers, grams, inside, buckets, least, n - 1, 2)
            return asked(asks(part.column("batch")[0].as_py(), n, grams[n - 1], inside[n - 1] & parts_frequent(found, n), buckets))

        return run

    def answer(part: pa.Table) -> pa.Table:
        """A bucket's count table, read out for each batch."""
        rows = part.to_pylist()
        out, words = [], sum(int(unpack_counts(r["counts"], len(r["rest"]) // 5).sum()) for r in rows if r["n"] == 1)
        for n in sorted({r["n"] for r in rows}):
            own = [r for r in rows if r["n"] == n]
            rests = [unpack_rests(r["rest"]) for r in own]
            counts = [unpack_counts(r["counts"], len(x)) for r, x in zip(own, rests, strict=True)]
            _, at = np.unique(np.concatenate(rests), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)[at]
            if n > 1:
                sums[sums < least] = 0
            ends = np.cumsum([len(x) for x in rests])
            out += [(r["batch"], r["bucket"], n, pack_counts(x), words) for r, x in zip(own, np.split(sums, ends[:-1]), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()], strict=True)], names=["batch", "bucket", "n", "counts", "tokens"])

    def score(part: pa.Table, answers: pa.Table) -> pa.Table:
        h, counts = batch_words(part)
        if len(h):
            grams, inside = ngrams(h, counts, order)
            value, used = position_scores(*answered(answers, grams, inside, buckets, least, order), factor)
        else:
            value, used = np.zeros(0), np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        sums = np.bincount(owner, weights=value, minlength=len(counts))
        orders = np.bincount(owner * (order + 1) + used, minlength=len(counts) * (order + 1)).reshape(-1, order + 1)[:, 1:]
        return pa.table({
            "doc_id": part.column("doc_id"), "n_words": pa.array(counts), "log_score": pa.array(sums),
            "mean_log_score": pa.array(sums / np.maximum(counts, 1)), "orders": pa.array(orders.tolist(), pa.list_(pa.int64())),
        })

    by_batch = dealt.groupBy("batch")
    answers = by_batch.applyInArrow(ask_short, ASK).groupBy("bucket").applyInArrow(answer, ANSWER)
    for n in range(3, order + 1):
        more = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(ask_longer(n), ASK).groupBy("bucket").applyInArrow(answer, ANSWER)
        answers = answers.unionByName(more)
    return by_batch.cogroup(answers.groupBy("batch")).applyInArrow(score, "doc_id long, n_words long, log_score double, mean_log_score double, orders array<long>").unionByName(wordless)


def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"), *[F.col("orders")[n - 1].alias(f"words_of_order_{n}") for n in range(1, ORDER + 1)])


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, w FROM d),
g AS (
  SELECT r, i, w[i] AS g1, CASE WHEN i >= 2 THEN w[i - 1] || ' ' || w[i] END AS g2,
         CASE WHEN i >= 3 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3,
         CASE WHEN i >= 2 THEN w[i - 1] END AS k1, CASE WHEN i >= 3 THEN w[i - 2] || ' ' || w[i - 1] END AS k2
  FROM p
),
c1 AS (SELECT g1 AS g, count(*) AS n FROM g GROUP BY ALL),
c2 AS (SELECT g2 AS g, count(*) AS n FROM g WHERE g2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
c3 AS (SELECT g3 AS g, count(*) AS n FROM g WHERE g3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT count(*) AS n FROM g),
s AS (
  SELECT r, CASE WHEN c3.n IS NOT NULL THEN 3 WHEN c2.n IS NOT NULL THEN 2 ELSE 1 END AS o,
         CASE WHEN c3.n IS NOT NULL THEN ln(c3.n / e2.n) WHEN c2.n IS NOT NULL THEN ln(0.4) + ln(c2.n / e1.n)
              ELSE 2 * ln(0.4) + ln(c1.n / t.n) END AS v
  FROM g JOIN c1 ON c1.g = g1 LEFT JOIN c2 ON c2.g = g2 LEFT JOIN c3 ON c3.g = g3
  LEFT JOIN c1 e1 ON e1.g = k1 LEFT JOIN c2 e2 ON e2.g = k2 CROSS JOIN t
)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(v, 0.0), 5) AS log_score,
       coalesce(n1, 0)::BIGINT AS words_of_order_1, coalesce(n2, 0)::BIGINT AS words_of_order_2, coalesce(n3, 0)::BIGINT AS words_of_order_3
FROM d LEFT JOIN (
  SELECT r, sum(v) AS v, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2, count(*) FILTER (o = 3) AS n3 FROM s GROUP BY r
) USING (r)
"""
