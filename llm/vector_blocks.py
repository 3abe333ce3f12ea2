"""Vectors, and their exact comparison in broadcast blocks.

Blocks of vectors of bounded size are broadcast one after the other, and every vector is compared with all of
each block: by products in single precision with a margin for their rounding, and what passes again in double
precision.  So no pair is lost, whatever the number of rows or their order.  Work grows with the number of
vectors times that of the queries, memory and shuffled rows don't.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, least_labels

#: Bytes of vectors that are broadcast at a time.
BLOCK_BYTES = 32 << 20
#: Rows and columns of one product, and edges that a task gathers before it contracts them.
ROWS, COLUMNS, EDGES = 512, 8192, 500_000


def unit_rows(blobs) -> np.ndarray:
    x = np.stack([np.frombuffer(b, np.float64) for b in blobs])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, vec) of vectors without null, non-finite or only zero components, one per id."""

    def run(batches):
        for batch in batches:
            keys, dims, blobs = [], [], []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is None or not vector or None in vector:
                    continue
                x = np.asarray(vector, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    keys.append(key)
                    dims.append(len(x))
                    blobs.append((x / top).tobytes())  # scaled, so that squares neither overflow nor vanish
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], names=["id", "dim", "vec"])

    found = rows.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "id long, dim int, vec binary")
    return found.groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("v")).select("id", "v.dim", "v.vec")


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float):
    """(i, j) arrays of all rows x[i] and y[j] of unit length whose product reaches the threshold."""
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    least = np.float32(threshold - (x.shape[1] + 8) * 2.0**-22)  # more than single precision can be off
    for s in range(0, len(x), ROWS):
        for t in range(0, len(y), COLUMNS):
            close = x32[s : s + ROWS] @ y32[t : t + COLUMNS].T >= least
            rows = np.flatnonzero(close.any(1))
            if len(rows):
                columns = np.flatnonzero(close[rows].any(0))
                i, j = np.nonzero(x[s + rows] @ y[t + columns].T >= threshold)
                yield s + rows[i], t + columns[j]


def contracted_edges(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes, each to the least one it is connected with."""
    nodes, least = least_labels(np.concatenate(left), np.concatenate(right))
    return nodes[nodes != least], least[nodes != least]


def block_links(vectors: DataFrame, blocks: int, block: int, threshold: float) -> DataFrame:
    """(edge, a, b) of the vectors (id, dim, vec, copies) of this block and later ones with those of this block.

    Rows with ``edge`` join nodes that are connected; the others give ``a`` further links to ``b`` rows.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(blocks))
    own = vectors.where(place == block).toArrow()
    sides = {}
    for dim in np.unique(own.column("dim").to_numpy()):
        part = own.filter(pa.array(own.column("dim").to_numpy() == dim))
        sides[int(dim)] = (part.column("id").to_numpy(), part.column("copies").to_numpy(), unit_rows(part.column("vec").to_pylist()))
    shared = vectors.sparkSession.sparkContext.broadcast(sides)

    def packed(edge, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), edge)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["edge", "a", "b"])

    def run(batches):
        sides = shared.value
        others = {dim: np.zeros(len(ids), np.int64) for dim, (ids, _, _) in sides.items()}
        left, right, held = [], [], 0
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in sides:
                    continue
                part = batch.filter(pa.array(dims == dim))
                ids, copies, later = (part.column(k).to_numpy(zero_copy_only=False) for k in ("id", "copies", "later"))
                block_ids, block_copies, y = sides[dim]
                counts = np.zeros(len(ids), np.int64)
                for i, j in near_pairs(unit_rows(part.column("vec").to_pylist()), y, threshold):
                    other = ids[i] != block_ids[j]
                    i, j = i[other], j[other]
                    if len(i):
                        np.add.at(counts, i, block_copies[j])
                        both = later[i]  # pairs within the block are met from either side
                        np.add.at(others[dim], j[both], copies[i[both]])
                        u, v = contracted_edges([ids[i]], [block_ids[j]])
                        left.append(u)
                        right.append(v)
                        held += len(u)
                        if held > EDGES:
                            u, v = contracted_edges(left, right)
                            left, right, held = [u], [v], 0
                            if len(u) > EDGES // 2:
                                yield packed(True, u, v)
                                left, right = [], []
                yield packed(False, ids[counts > 0], counts[counts > 0])
        for dim, counts in others.items():
            yield packed(False, sides[dim][0][counts > 0], counts[counts > 0])
        if left:
            yield packed(True, *contracted_edges(left, right))

    found = cut(vectors.where(place >= block).withColumn("later", place > block).mapInArrow(run, "edge boolean, a long, b long"))
    shared.destroy()
    return found


def all_links(vectors: DataFrame, threshold: float, block_bytes: int | None = None) -> DataFrame:
    """(edge, a, b) of all pairs of vectors (see ``block_links``), a block at a time."""
    size = vectors.agg(F.sum(F.length("vec"))).first()[0] or 0
    blocks = max(1, -(-size // (block_bytes or BLOCK_BYTES)))
    found = block_links(vectors, blocks, 0, threshold)
    for block in range(1, blocks):
        found = found.unionByName(block_links(vectors, blocks, block, threshold))
    return found


def links_of(queries: DataFrame, vectors: DataFrame, threshold: float, block_bytes: int | None = None) -> DataFrame:
    """(id, n_links): for every query (id, dim, vec), how many of ``vectors`` (id, dim, vec) with other ids reach the threshold."""
    size = queries.agg(F.sum(F.length("vec"))).first()[0] or 0
    blocks = max(1, -(-size // (block_bytes or BLOCK_BYTES)))
    found = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        dims = own.column("dim").to_numpy()
        sides = {int(d): (own.column("id").to_numpy()[dims == d], unit_rows([b for b, k in zip(own.column("vec").to_pylist(), dims, strict=True) if k == d])) for d in np.unique(dims)}
        shared = queries.sparkSession.sparkContext.broadcast(sides)

        def run(batches, shared=shared):
            totals = {dim: np.zeros(len(ids), np.int64) for dim, (ids, _) in shared.value.items()}
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim, (ids, y) in shared.value.items():
                    part = batch.filter(pa.array(dims == dim))
                    if part.num_rows:
                        other = part.column("id").to_numpy()
                        for i, j in near_pairs(unit_rows(part.column("vec").to_pylist()), y, threshold):
                            np.add.at(totals[dim], j[other[i] != ids[j]], 1)
            for dim, counts in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[dim][0], pa.int64()), pa.array(counts, pa.int64())], names=["id", "n"])

        part = cut(vectors.select("id", "dim", "vec").mapInArrow(run, "id long, n long"))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found.groupBy("id").agg(F.sum("n").alias("n_links"))
