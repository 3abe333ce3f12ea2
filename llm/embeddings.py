"""Near-duplicate vectors by sorted projection passes.

Each pass orders all vectors by the signs of random projections, read as one long bit string; similar
vectors tend to stand close together.  Every vector is compared with its next ``window`` neighbours, in
double precision, and verified pairs are united over all passes.  Projections are taken from the vectors' common
mean, which encoders' vectors have.  The number of passes grows with that of the vectors and with how crowded they
stand, which a bounded sample tells, so that a pair at the threshold is met with a stated probability (see
``passes_among``).  Tables of all sizes go through passes.
Within each component, links are then counted exactly, tile against tile, so a component may be of any size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, least_labels, partitions, salted_join, small_batches, table
from .tiles import tile_pairs
from .vector_blocks import all_links, links_of, unit_rows, valid_vectors

WINDOW, BITS = 128, 62
#: Probability that a pair at the threshold is met in some pass.
RECALL = 0.995
#: The same where vectors stand crowded: there the sample's average tells less of the single pair.
CROWDED_RECALL = 0.9999
#: Passes of one job, and members of a tile.
AT_ONCE, TILE = 8, 2048
#: Vectors that tell the mean and the crowding of all.
SAMPLE = 1000
#: Passes beyond which the rest of crowded pairs would be lost by any number that can be run, so that all pairs are compared instead.
#: ``PASS_COST`` (vectors that all can be compared with for what a pass costs) once chose all pairs for smaller tables and decides nothing now.
PASS_COST, MOST = 5000, 20_000


def passes_for(vectors: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has been within the window with probability ``recall``.

    One bit is equal for two vectors at the angle a with probability 1 - a / pi.  Vectors that share the first
    log2(n / window) bits stand in one window of n evenly spread ones, so a pass meets the pair with
    probability (n / window) ** log2(1 - a / pi), and passes grow with that power of n: about its 0.22th at
    cosine 0.9, where comparing all pairs grows with n itself.
    """
    if vectors <= window + 1:
        return 1
    same = 1 - math.acos(threshold) / math.pi
    met = (vectors / window) ** math.log2(same)
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-met))) if met < 1 else 1


def passes_among(x: np.ndarray, vectors: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which pairs at the threshold have been within the window with probability ``recall``, on average over the sample ``x``.

    ``x`` has unit rows out of ``vectors``.  Seen from the sample's mean, two vectors at the angle a share L bits with
    probability (1 - a / pi) ** L.  For each row, L is the length of key that it shares with as many vectors as the
    window holds, by its angles to the others; those that reach the threshold with it are left out, since
    standing among them is no loss.  A pair is met if it shares these L bits, at the angle that a vector at the threshold
    has from here.
    """
    if vectors <= window + 1 or len(x) < 2:
        return passes_for(vectors, threshold, window, recall)
    mean = x.mean(axis=0)
    plain, own, m2 = x @ x.T, x @ mean, float(mean @ mean)
    size = np.sqrt(np.maximum(1 - 2 * own + m2, 1e-12))
    cosine = (plain - own[:, None] - own[None, :] + m2) / (size[:, None] * size[None, :])
    logs = np.log(np.maximum(1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi, 1e-9))
    logs[(plain >= threshold) | np.eye(len(x), dtype=bool)] = -np.inf
    low, high = np.zeros(len(x)), np.full(len(x), float(BITS))
    for _ in range(20):
        middle = (low + high) / 2
        crowded = vectors * np.exp(logs * np.maximum(middle, 1e-6)[:, None]).mean(axis=1) > window
        low, high = np.where(crowded, middle, low), np.where(crowded, high, middle)
    other = np.sqrt(np.maximum(1 - 2 * threshold * own + m2, 1e-12))
    near = np.clip((threshold - own - threshold * own + m2) / (size * other), -1, 1)
    met = np.exp(high * np.log(np.maximum(1 - np.arccos(near) / np.pi, 1e-9)))
    passes = 1
    while np.mean((1 - met) ** passes) > 1 - recall and passes < MOST:
        passes += max(1, passes // 50)
    return passes


def crowding(vectors: DataFrame, threshold: float, window: int) -> tuple[dict[int, np.ndarray], int, bool]:
    """By length of vector the mean of unit vectors, from a sample of ``SAMPLE`` in hashed order; the passes that the vectors ask for; whether no number of passes would do.

    What the sample asks for counts only if evenly spread vectors would ask for less than half of it.
    """
    counts = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}
    rows = vectors.select("dim", "vec").orderBy(F.xxhash64(F.lit(5), "vec"), "vec").limit(SAMPLE).collect()
    means, passes = {}, max((passes_for(n, threshold, window) for n in counts.values()), default=1)
    for dim in counts:
        own = [r["vec"] for r in rows if r["dim"] == dim]
        if len(own) > 1:
            x = unit_rows(own)
            means[dim] = x.mean(axis=0)
            asked = passes_among(x, counts[dim], threshold, window)
            if asked > 2 * passes_for(counts[dim], threshold, window):
                asked = passes_among(x, counts[dim], threshold, window, CROWDED_RECALL)
            passes = max(passes, asked)
    return means, passes, passes >= MOST


def projection_keys(vectors: DataFrame, passes: range, seed: int, means: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(pass, dim, key, id, vec): a row per pass, with the signs of ``BITS`` projections, seen from the mean, as one number."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.concatenate([np.random.default_rng((seed, p, int(dim))).normal(size=(int(dim), BITS)) for p in passes], 1)
                part = batch.filter(pa.array(dims == dim))
                x = unit_rows(part.column("vec").to_pylist()) - (means or {}).get(int(dim), 0.0)
                for at in range(0, len(x), 512):
                    signs = (x[at : at + 512] @ planes[dim] > 0).reshape(-1, len(passes), BITS)
                    keys = signs.astype(np.int64) @ weights
                    own = part.slice(at, 512)
                    for k, p in enumerate(passes):
                        n = own.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), own.column("dim"), pa.array(keys[:, k]), own.column("id"), own.column("vec")], names=["pass", "dim", "key", "id", "vec"])

    return vectors.mapInArrow(run, "pass int, dim int, key long, id long, vec binary")


def window_edges(x: np.ndarray, strata: np.ndarray, ids: np.ndarray, window: int, threshold: float, block: int = 128) -> list[tuple[int, int]]:
    """Edges that join the same rows as all verified pairs at most ``window`` apart and of one stratum."""
    left, right = [], []
    for at in range(0, len(x), block):
        a, b = x[at : at + block], x[at : at + block + window]
        i, j = np.nonzero(a @ b.T >= threshold)
        ok = (j > i) & (j - i <= window)
        i, j = i[ok] + at, j[ok] + at
        same = strata[i] == strata[j]
        left.append(i[same])
        right.append(j[same])
    left, right = np.concatenate(left), np.concatenate(right)
    nodes, least = least_labels(left, right)
    moved = nodes != least
    return [(int(a), int(b)) for a, b in zip(ids[nodes[moved]], ids[least[moved]], strict=True) if a != b]


def sorted_pass_edges(vectors: DataFrame, threshold: float, passes: range, window: int, seed: int, means: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(a, b): edges of these passes.

    Rows are range-partitioned in sort order, ties split by id, so that equal keys never crowd one task.
    Each task compares its own rows; the last rows of a partition meet the first of the next in a second step.
    """
    keyed = projection_keys(vectors, passes, seed, means)
    order = ["pass", "dim", "key", "id"]
    dealt = keyed.repartitionByRange(partitions(vectors), *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        tail = None
        first: list = []

        def packed(kind, pairs, rows=()):
            a, b = [p[0] for p in pairs] + [r[0] for r in rows], [p[1] for p in pairs] + [r[1] for r in rows]
            blobs = [None] * len(pairs) + [r[2] for r in rows]
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "a", "b", "vec"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096).to_pandas()
                if len(first) < window:
                    first += list(rows[["pass", "dim", "id", "vec"]].itertuples(index=False))[: window - len(first)]
                rows = rows if tail is None else pd.concat([tail, rows], ignore_index=True)
                for dim, part in rows.groupby("dim"):
                    edges = window_edges(unit_rows(part["vec"]), part["pass"].to_numpy(), part["id"].to_numpy(), window, threshold)
                    if edges:
                        yield packed(-1, edges)
                tail = rows.tail(window)
        if tail is not None:
            place = lambda r: r[0] << 32 | r[1]
            head = [(r[2], place(r), r[3]) for r in first]
            end = [(r[2], place(r), r[3]) for r in tail[["pass", "dim", "id", "vec"]].itertuples(index=False)]
            if own:
                yield packed(2 * own - 1, [], head)
            yield packed(2 * own + 2, [], end)

    found = cut(dealt.mapInArrow(run, "kind int, a long, b long, vec binary"))
    # The tail of partition p is kind 2p + 2 and the head of partition p kind 2p - 1, so tail p and head p + 1 share border p + 1.
    border = F.expr("(kind + 1) div 2")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = []
        pdf = pdf.assign(head=pdf["kind"] % 2 == 1)
        for _, part in pdf.groupby("b"):  # of one pass and length
            if part["head"].any() and not part["head"].all():
                part = part.sort_values("head", kind="stable")
                edges += window_edges(unit_rows(part["vec"]), np.zeros(len(part)), part["a"].to_numpy(), window, threshold)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    across = found.where("kind > 0").withColumn("border", border).groupBy("border").applyInPandas(meet, "a long, b long")
    return found.where("kind < 0").select("a", "b").unionByName(across)


def all_pass_edges(vectors: DataFrame, threshold: float, passes: int, window: int, seed: int, means: dict[int, np.ndarray] | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """(a, b): edges of all passes, ``at_once`` passes a job; only contracted edges are kept of each."""
    found = None
    for first in range(0, passes, at_once):
        edges = cut(sorted_pass_edges(vectors, threshold, range(first, min(passes, first + at_once)), window, seed, means))
        found = edges if found is None else found.unionByName(edges)
    return found


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, n_links): for every member (root, dim, id, vec, copies), how many copies of others of its component reach the threshold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(len(pdf), np.int64)
        tile, copies, diagonal = pdf["tile"].to_numpy(), pdf["copies"].to_numpy(), pdf["first"].iloc[0] == pdf["second"].iloc[0]
        for _, at in pdf.groupby("dim").indices.items():
            x, own = unit_rows(pdf["vec"].to_numpy()[at]), tile[at]
            for start in range(0, len(at), 512):
                rows = slice(start, start + 512)
                close = x[rows] @ x.T >= threshold
                if diagonal:
                    close[np.arange(len(close)), np.arange(start, start + len(close))] = False
                else:
                    close &= own[rows, None] != own[None, :]
                counts[at[rows]] = close @ copies[at]
        return pd.DataFrame({"id": pdf["id"], "n": counts})

    tiled = tile_pairs(members, "root", "id", TILE)
    return tiled.groupBy("root", "first", "second").applyInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, passes: int | None = None, window: int = WINDOW, seed: int = 23, exact: bool = False
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    ``passes`` is taken from the distinct vectors unless given (see ``crowding``).  With ``exact`` all pairs are compared
    instead, in broadcast blocks: nothing can be lost then, and work grows with the square of the vectors.

    Vectors that are null, zero, empty, or hold null or non-finite components, and rows with a null id, link
    with nothing; vectors of different lengths don't link.  Rows that repeat an id count as one vector (the
    least) and get equal results.  Vectors of the same direction, bit by bit, are compared as one, which
    stands for all its copies.  Columns other than the two named are ignored.
    """
    valid = cut(valid_vectors(small_batches(rows), id_col, vector_col))
    vectors = cut(valid.groupBy("dim", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")).repartition(partitions(rows), "id"))
    means, asked, dense = ({}, passes, False) if exact or passes else crowding(vectors, threshold, window)
    if exact or dense:
        links = all_links(vectors, threshold)
        roots = components(links.where("edge").select("a", "b"))
        counts = links.where("NOT edge").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n_links"))
    else:
        edges = all_pass_edges(vectors.select("id", "dim", "vec"), threshold, asked, window, seed, means)
        roots = cut(components(edges))
        counts = count_links(vectors.join(roots.withColumnRenamed("node", "id"), "id"), threshold)
    linked = cut(roots.join(counts, F.col("node") == F.col("id")).select("node", "root", "n_links"))
    copied = vectors.where("copies > 1").join(linked, F.col("id") == F.col("node"), "left").select(
        F.col("vec").alias("same"), F.coalesce("root", "id").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    single = linked.join(vectors.where("copies > 1").select("id"), F.col("node") == F.col("id"), "left_anti").select(F.col("node").alias("found_id"), "root", "n_links")
    found = single.unionByName(salted_join(valid, copied, "vec", "same").select(F.col("id").alias("found_id"), "root", "n_links"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id")).join(found, F.col("vec_id") == F.col("found_id"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("root", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def recall_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, every: int = 50) -> DataFrame:
    """(vec_id, n_links, n_found) of vectors whose id is divisible by ``every``: links by brute force against all rows, and those found.

    Brute force goes block by block of the queries, so memory doesn't grow with them.
    """
    valid = cut(valid_vectors(small_batches(rows), id_col, vector_col))
    exact = links_of(valid.where(F.col("id") % every == 0), valid, threshold)
    found = near_vectors(rows, id_col, vector_col, threshold).groupBy("vec_id").agg(F.max("n_links").alias("n_found"))
    return exact.join(found, F.col("id") == F.col("vec_id")).select("vec_id", "n_links", "n_found")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def embeddings_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall_rows(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
),
u AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) >= 0.9 * a.n * b.n
),
r AS (SELECT vec_id, vec_id AS m FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.m)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id)::BIGINT AS n_links, min(m) AS component_id, min(m) = vec_id AS kept
FROM r GROUP BY vec_id
"""


#: Links of every fiftieth vector; the same as those found if no link is lost.
RECALL_SQL = """
WITH u AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)
SELECT a.vec_id, count(b.vec_id) AS n_links, count(b.vec_id) AS n_found
FROM (SELECT * FROM u WHERE vec_id % 50 = 0 AND n > 0) a
LEFT JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND b.n > 0 AND list_dot_product(a.e, b.e) >= 0.9 * a.n * b.n
GROUP BY a.vec_id
"""
