"""Bounded samples of labelled rows, on which the models are fitted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a training sample takes of each class; scoring reads every text whole.
CLASS_BYTES = 32 << 20
#: Draws are multiples of one in this many.
DRAWS = 1 << 20


def labelled(docs: DataFrame, labels: DataFrame, label: str, train) -> DataFrame:
    """(doc_id, y) of labelled documents, the least label of each; ``train`` is the condition on doc_id that a training row meets.

    Only ids are joined, no texts.  A null id or label teaches nothing; rows that repeat an id count once.
    """
    known = labels.where(F.col(label).isNotNull() & train).groupBy(F.col("doc_id").alias("known_id")).agg(F.min(label).cast("string").alias("y"))
    ids = docs.where(train).select("doc_id")
    return ids.join(known, F.col("doc_id") == F.col("known_id")).groupBy("doc_id").agg(F.min("y").alias("y"))


def sample(docs: DataFrame, ids: DataFrame, per_class: int, class_bytes: int = CLASS_BYTES, seed: int = 11, extra: tuple[str, ...] = ()) -> tuple[pd.DataFrame, dict]:
    """At most ``per_class`` rows (doc_id, text, y, further columns) of each class, and the number of rows of each.

    ``ids`` (doc_id, y) names the labelled rows.  Ids are drawn by a seeded hash, about as many as needed, so
    nothing is sorted; of these the least draws whose texts have ``class_bytes`` together are taken, whatever
    the length of each, and only they are read.  Both bounds are parameters and the driver holds no more than
    they allow.  Null texts are empty ones; of rows that repeat an id the least text counts.
    """
    spark = docs.sparkSession
    counts = {r["y"]: r["n"] for r in ids.where("y IS NOT NULL").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"doc_id": [], "text": [], "y": [], **{c: [] for c in extra}}), counts
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(DRAWS))
    share = F.create_map([x for y, n in sorted(counts.items()) for x in (F.lit(y), F.lit(int(DRAWS * min(1.0, (1.2 * per_class + 20) / n))))])
    drawn = ids.where("doc_id IS NOT NULL").withColumn("draw", draw).where(F.col("draw") < share[F.col("y")])
    # About 1.2 * per_class + 20 ids of each class, a size that the parameter bounds, so they are broadcast.
    drawn = drawn.groupBy(F.col("doc_id").cast("long").alias("drawn_id")).agg(F.min(F.struct("draw", "y")).alias("v")).select("drawn_id", "v.draw", "v.y")
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.coalesce("text", F.lit("")).alias("own_text"), *[F.col(c).alias(f"own_{c}") for c in extra])
    sizes = (
        texts.select("own_id", F.octet_length("own_text").alias("bytes")).join(F.broadcast(drawn), F.col("own_id") == F.col("drawn_id"))
        .groupBy("own_id", "draw", "y").agg(F.max("bytes").alias("bytes")).toPandas().sort_values(["draw", "own_id"], kind="stable")
    )
    taken = []
    for _, part in sizes.groupby("y"):
        part = part[part["bytes"] <= class_bytes]
        part = part[np.cumsum(part["bytes"].to_numpy(np.int64)) <= class_bytes]
        taken.append(part.head(per_class))
    taken = pd.concat(taken)[["own_id", "y"]]
    if not len(taken):
        return pd.DataFrame({"doc_id": [], "text": [], "y": [], **{c: [] for c in extra}}), counts
    wanted = F.broadcast(spark.createDataFrame([(int(i),) for i in taken["own_id"]], "taken_id long"))
    rows = texts.join(wanted, F.col("own_id") == F.col("taken_id")).groupBy("own_id").agg(F.min(F.struct("own_text", *[f"own_{c}" for c in extra])).alias("v"))
    found = rows.select("own_id", "v.*").toPandas().merge(taken, on="own_id").sort_values("own_id", kind="stable", ignore_index=True)
    return found.rename(columns={f"own_{c}": c for c in ("text", *extra)} | {"own_id": "doc_id"}), counts
