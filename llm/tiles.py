"""Groups of any size, compared tile against tile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crowds(members: DataFrame, group: str, rows: int, weight: str | None = None, heavy: int = 0) -> DataFrame:
    """(g_, tiles, members, load) of groups that need several tiles; of these there are at most a ``rows``-th of the members, or a ``heavy``-th of their weight."""
    size = F.ceil(F.count("*") / F.lit(rows))
    load = F.sum(weight) if weight else F.count("*")
    if weight:
        size = F.greatest(size, F.ceil(load / F.lit(heavy)))
    return members.groupBy(F.col(group).alias("g_")).agg(size.cast("int").alias("tiles"), F.count("*").alias("members"), load.alias("load")).where("tiles > 1")


def tile_pairs(members: DataFrame, group: str, key: str, rows: int, weight: str | None = None, heavy: int = 0) -> DataFrame:
    """``members`` with (tile, other, first, second): one row for each pair of tiles that the row takes part in.

    A group with more than ``rows`` members, or more than ``heavy`` of ``weight``, is dealt by hash into
    tiles within those bounds (as expected values); every unordered pair of tiles is then a task's work of
    bounded size, and together they cover all pairs of the group.  A small group is one tile; only the others are
    looked up, by broadcast, so that members are shuffled once.
    """
    tiles = F.broadcast(crowds(members, group, rows, weight, heavy).select("g_", "tiles"))
    dealt = members.join(tiles, F.col(group) == F.col("g_"), "left").drop("g_").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64(F.lit(7), key), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.withColumn("first", F.least("tile", "other")).withColumn("second", F.greatest("tile", "other")).drop("tiles", "other")


def merge_labels(labels: np.ndarray, links: np.ndarray, first: int) -> None:
    """Joins, in ``labels``, row first + i with every column where links[i] holds."""
    for i in range(len(links)):
        other = np.nonzero(links[i])[0]
        if len(other):
            found = np.unique(np.append(labels[other], labels[first + i]))
            if len(found) > 1:
                labels[np.isin(labels, found[1:])] = found[0]
