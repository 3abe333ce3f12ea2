"""Exact k-means over integer vectors by kd-tree filtering.

Each partition's vectors are put into kd-trees of bounded size.  A node holds its number of vectors, their exact
componentwise sum, the sum of their squared norms, and its box.  In a round every tree is walked with the set of
centroids that may still be nearest to some point of a node's box: a centroid that is strictly farther than another
from every point of the box is pruned, so ties stay undecided.  A node with one centroid left is assigned as a whole
by its sums; a leaf with several is resolved vector by vector.  All arithmetic is on integers, so the result doesn't
depend on how vectors are dealt into trees.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table

#: Vectors of a tree and of a leaf.
TREE, LEAF = 16_384, 64
#: Components are held to this magnitude (131,072 as a double): a squared distance then fits a 64-bit integer.
LARGEST = (1 << 27) - 1
#: Components below this are multiplied as doubles, exactly: 64 products of them sum up to less than 2^53.
SMALL = 1 << 22
#: Sums of squares are added up in two parts, so that none overflows.
HALF, LOW = 31, (1 << 31) - 1


def whole_numbers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have ``dims`` components, none null or non-finite, and floor(scale * x) of their components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    right = np.nonzero(sizes == dims)[0]
    flat = column.take(pa.array(right)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(x).all(axis=1)
    limit = np.floor(np.clip(x[finite] * scale, -LARGEST, LARGEST))
    return right[finite], limit.astype(np.int64)


def kd_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the rows, and the nodes over it: start, stop, right child (0: a leaf), sum, squares, low and high.

    A node's left child is the node after it.  Nodes are halved at the median of their widest component; a node
    whose rows are all equal is a leaf of any size.
    """
    order = np.arange(len(x))
    norms = (x * x).sum(axis=1)
    nodes: list[list] = []

    def build(start: int, stop: int) -> None:
        own = x[order[start:stop]]
        low, high = own.min(axis=0), own.max(axis=0)
        norm = norms[order[start:stop]]
        squares = (int((norm >> HALF).sum()) << HALF) + int((norm & LOW).sum())
        node = [start, stop, 0, own.sum(axis=0), squares, low, high]
        nodes.append(node)
        widest = int(np.argmax(high - low))
        if stop - start > leaf and high[widest] > low[widest]:
            half = (stop - start) // 2
            order[start:stop] = order[start:stop][np.argpartition(own[:, widest], half)]
            build(start, start + half)
            node[2] = len(nodes)
            build(start + half, stop)

    build(0, len(x))
    names = ("start", "stop", "right", "sum", "squares", "low", "high")
    return order, {name: np.array([n[i] for n in nodes], object if name == "squares" else np.int64) for i, name in enumerate(names)}


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if len(x) and max(np.abs(x).max(), np.abs(centroids).max()) >= SMALL:
        return np.array([((x - c) ** 2).sum(axis=1) for c in centroids]).T
    cross = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    return (x * x).sum(axis=1)[:, None] - 2 * cross + (centroids * centroids).sum(axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Those of ``alive`` that aren't strictly farther than the one nearest to the box's middle from every point of the box."""
    own = centroids[alive]
    middle = 2 * own - (low + high)
    best = own[np.argmin((middle.astype(np.float64) ** 2).sum(axis=1))]
    away = own - best
    corner = np.where(away > 0, high, low)  # the point of the box where the other does best
    # |z - v|^2 - |b - v|^2 = (z - b) (z + b - 2 v), summed over components.
    return alive[(away * (own + best - 2 * corner)).sum(axis=1) <= 0]


def walk(x: np.ndarray, nodes: dict[str, np.ndarray], centroids: np.ndarray, whole, single) -> None:
    """Calls ``whole(node, c)`` for nodes that belong to centroid c altogether, and ``single(start, stop, labels, distances)`` for other leaves."""
    stack = [(0, np.arange(len(centroids)))]
    while stack:
        node, alive = stack.pop()
        alive = candidates(nodes["low"][node], nodes["high"][node], centroids, alive) if len(alive) > 1 else alive
        if len(alive) == 1:
            whole(node, int(alive[0]))
        elif nodes["right"][node]:
            stack += [(int(nodes["right"][node]), alive), (node + 1, alive)]
        else:
            start, stop = int(nodes["start"][node]), int(nodes["stop"][node])
            far = distances(x[start:stop], centroids[alive])
            own = np.argmin(far, axis=1)  # the first of equals, which has the smaller number
            single(start, stop, alive[own], far[np.arange(len(own)), own])


TREE_KIND = "ids binary, missing binary, vectors binary, places binary, sums binary, squares array<string>"


def trees(rows: DataFrame, id_col: str, vector_col: str, dims: int, scale: int, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """A row for each tree of up to ``tree`` vectors of a partition, its arrays packed."""

    def packed(ids: np.ndarray, missing: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order, nodes = kd_tree(x, leaf)
        places = np.concatenate([nodes["start"][:, None], nodes["stop"][:, None], nodes["right"][:, None], nodes["low"], nodes["high"]], axis=1)
        blobs = [ids[order].astype("<i8"), missing[order].astype("u1"), x[order].astype("<i4"), places.astype("<i4"), nodes["sum"].astype("<i8")]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([b.tobytes()], pa.binary()) for b in blobs), pa.array([[str(s) for s in nodes["squares"]]], pa.list_(pa.string()))],
            names=["ids", "missing", "vectors", "places", "sums", "squares"],
        )

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            kept, x = whole_numbers(batch.column(1), dims, scale)
            own = batch.column(0).take(pa.array(kept))
            held.append((own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False), x))
            n += len(x)
            if n >= tree:
                ids, missing, x = (np.concatenate(c) for c in zip(*held, strict=True))
                for at in range(0, n - n % tree, tree):
                    yield packed(ids[at : at + tree], missing[at : at + tree], x[at : at + tree])
                at = n - n % tree
                held, n = [(ids[at:], missing[at:], x[at:])], n % tree
        if n:
            yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return small_batches(rows).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).mapInArrow(run, TREE_KIND)


def opened(batch: pa.RecordBatch, i: int, dims: int):
    """The tree of row ``i``: ids, null ids, vectors and nodes."""
    raw = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
    places = np.frombuffer(raw["places"], "<i4").astype(np.int64).reshape(-1, 3 + 2 * dims)
    nodes = {
        "start": places[:, 0], "stop": places[:, 1], "right": places[:, 2], "low": places[:, 3 : 3 + dims], "high": places[:, 3 + dims :],
        "sum": np.frombuffer(raw["sums"], "<i8").reshape(-1, dims), "squares": raw["squares"],
    }
    return np.frombuffer(raw["ids"], "<i8"), np.frombuffer(raw["missing"], "u1"), np.frombuffer(raw["vectors"], "<i4").astype(np.int64).reshape(-1, dims), nodes


def round_sums(forest: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """By cluster: its number of vectors, the sum of their squared distances, and their componentwise sum.

    A tree gives a row a cluster; only as many rows as centroids reach the driver.
    """
    k, dims = centroids.shape
    norms = [int((c.astype(object) ** 2).sum()) for c in centroids]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, x, nodes = opened(batch, i, dims)
                count, far, total = [0] * k, [0] * k, np.zeros((k, dims), np.int64)

                def whole(node, c, count=count, far=far, total=total, nodes=nodes):
                    n = int(nodes["stop"][node] - nodes["start"][node])
                    count[c] += n
                    total[c] += nodes["sum"][node]
                    far[c] += int(nodes["squares"][node]) + n * norms[c] - 2 * sum(int(a) * int(b) for a, b in zip(nodes["sum"][node], centroids[c], strict=True))

                def single(start, stop, labels, found, count=count, far=far, total=total, x=x):
                    for c in np.unique(labels).tolist():
                        own = labels == c
                        count[c] += int(own.sum())
                        total[c] += x[start:stop][own].sum(axis=0)
                        far[c] += sum(found[own].tolist())

                walk(x, nodes, centroids, whole, single)
                own = [c for c in range(k) if count[c]]
                parts = [[count[c], far[c] >> HALF, far[c] & LOW, *total[c].tolist()] for c in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["cluster", "parts"])

    found = forest.mapInArrow(run, "cluster int, parts array<long>").select("cluster", F.posexplode("parts").alias("at", "part"))
    sums: dict[int, dict[int, int]] = {}
    for cluster, at, part in found.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(20,0)"))).collect():
        sums.setdefault(cluster, {})[at] = int(part)
    return {c: (s[0], (s[1] << HALF) + s[2], [s[3 + j] for j in range(dims)]) for c, s in sums.items()}


def assigned(forest: DataFrame, centroids: np.ndarray, inertia: dict[int, int]) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
    k, dims = centroids.shape
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_all, own = sum(inertia.values()), [inertia.get(c, 0) for c in range(k)]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, missing, x, nodes = opened(batch, i, dims)
                labels, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)

                def whole(node, c, labels=labels, far=far, x=x, nodes=nodes):
                    start, stop = int(nodes["start"][node]), int(nodes["stop"][node])
                    labels[start:stop], far[start:stop] = c, distances(x[start:stop], centroids[c : c + 1])[:, 0]

                def single(start, stop, found, d, labels=labels, far=far):
                    labels[start:stop], far[start:stop] = found, d

                walk(x, nodes, centroids, whole, single)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=missing.astype(bool)), pa.array(labels, pa.int32()), pa.array(far), pa.array([own[c] for c in labels], pa.int64()), pa.array([of_all] * len(x), pa.int64()), pa.array([marks[c] for c in labels])],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return forest.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def starting_vectors(rows: DataFrame, id_col: str, vector_col: str, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` kept vectors with the smallest sha256 of "seed:id", in that order; equal hashes by vector, null ids never."""
    vec = F.col(vector_col).cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") == dims) & good)
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "vec").orderBy("h", "vec").limit(k).collect()
    if not first:
        return np.zeros((0, dims), np.int64)
    return whole_numbers(pa.array([r["vec"] for r in first], pa.list_(pa.float64())), dims, scale)[1]


def cluster_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector, after ``rounds`` rounds.

    Vectors of another length, null ones, and those with null or non-finite components are left out.  A component x
    becomes floor(scale * x), held to +-``LARGEST`` so that distances fit 64 bits.  Ties go to the smaller centroid; an
    empty cluster keeps its centroid; fewer kept vectors than ``k`` make fewer centroids.  Repeated rows and rows
    with a null id (which never start a centroid) are clustered each.  Only the two columns named are read.  A table
    without kept vectors gives no rows.  The driver holds ``k`` centroids and their sums, whatever the number of rows.
    """
    centroids = starting_vectors(rows, id_col, vector_col, k, dims, scale, seed)
    forest = cut(trees(rows, id_col, vector_col, dims, scale, tree, leaf))
    if not len(centroids):
        return assigned(forest.limit(0), np.zeros((1, dims), np.int64), {})
    for _ in range(rounds):
        found = round_sums(forest, centroids)
        centroids = np.array([[s // found[c][0] for s in found[c][2]] if c in found else centroids[c].tolist() for c in range(len(centroids))], np.int64)
    return assigned(forest, centroids, {c: f[1] for c, f in round_sums(forest, centroids).items()})


def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def unrolled_sql(k: int = 8, rounds: int = 10) -> str:
    """The same by brute force: every round's assignment and centroids as two tables."""
    nearest = """a{i} AS MATERIALIZED (
  SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT vec_id, x, c, list_sum(list_transform(list_zip(x, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}
  ) GROUP BY vec_id, x
)"""
    moved = """c{j} AS MATERIALIZED (
  SELECT c, coalesce(m, z) AS z FROM c{i} LEFT JOIN (
    SELECT c, list(s // n - (CASE WHEN s % n < 0 THEN 1 ELSE 0 END) ORDER BY k)::BIGINT[] AS m FROM (
      SELECT c, k, sum(x[k])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) r(k) GROUP BY c, k
    ) GROUP BY c
  ) USING (c)
)"""
    parts = ["""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
)""", f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x AS z FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"]
    for i in range(rounds):
        parts += [nearest.format(i=i), moved.format(i=i, j=i + 1)]
    parts.append(nearest.format(i=rounds))
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(z, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


SQL = unrolled_sql()
