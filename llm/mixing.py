"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a share of all words by its weight, at most ``max_repeats`` times its own words.  Whole
passes over a source fill most of its target; what is left is a budget that a subset of the source's
documents has to fill.  Documents are counted by exact length.  A proportional share of each length is
taken at once; the small rest of the budget is fitted by dynamic programming over the lengths that remain
(bounded knapsack, solved as subset sum on bit sets), and documents of each length are then chosen in a
seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
#: Words that the dynamic program fits; its table has this many bits for each length, whatever the input.
DP_BUDGET = 1 << 14
#: Cells of the table in which a budget that is still not met is fitted as a whole, at 5 bytes a cell, and cells that its steps visit together.
CELLS, WORK = 1 << 25, 1 << 32


def whole_fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length have the largest sum up to ``budget``: subset sum over the whole of it."""
    taken = np.zeros(len(lengths), np.int64)
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    step = np.zeros(budget + 1, np.int32)  # the step that first reached a sum; what it was added to was reached before
    parts: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        most = min(int(counts[i]), budget // length) if length > 0 else 0
        power = 1
        while most > 0 and not reach[budget]:
            part = min(power, most)
            new = reach[: budget + 1 - part * length] & ~reach[part * length :]
            step[part * length :][new] = len(parts)
            reach[part * length :] |= new
            parts.append((int(i), part))
            most -= part
            power *= 2
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, part = parts[step[at]]
        taken[i] += part
        at -= part * int(lengths[i])
    return taken


def coarse_fit(lengths: np.ndarray, counts: np.ndarray, budget: int, cells: int = CELLS, work: int = WORK) -> np.ndarray:
    """How many documents of each length have about the largest sum up to ``budget``, in bounded memory and time at any budget.

    The subset sum is over units: the lengths' common divisor, or as many times it as keeps the table within ``cells`` and
    its steps within ``work``.  Lengths are rounded up to units, so no sum is above the budget; with units of the divisor
    alone the sum is the largest there is, and otherwise each document may leave less than a unit.
    """
    usable = (lengths > 0) & (counts > 0) & (lengths <= budget)
    if not usable.any():
        return np.zeros(len(lengths), np.int64)
    divisor = int(np.gcd.reduce(lengths[usable]))
    most = np.minimum(counts[usable], budget // lengths[usable])
    steps = sum(int(m).bit_length() for m in most)
    whole = budget // divisor
    unit = max(1, -(-whole // cells), -(-whole * steps // work))
    return whole_fit(np.where(usable, -(-(lengths // divisor) // unit), 0), counts, whole // unit)


def filled(lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray, budget: int) -> np.ndarray:
    """``taken`` with whatever documents still fit, the longest first: what is left is less than the shortest one not taken."""
    left = budget - int((taken * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] > 0:
            more = min(int(counts[i] - taken[i]), left // int(lengths[i]))
            taken[i] += more
            left -= more * int(lengths[i])
    return taken


def fine_fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int) -> np.ndarray:
    """A proportional share, the longest lengths until ``dp_budget`` words are left, and the exact subset sum of these."""
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.copy()
    spare = min(dp_budget // 2, budget)
    taken = counts * (budget - spare) // total
    left = budget - int((taken * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= dp_budget:
            break
        if lengths[i] > 0:
            more = min(int(counts[i] - taken[i]), (left - dp_budget // 2) // int(lengths[i]))
            if more > 0:
                taken[i] += more
                left -= more * int(lengths[i])
    left = min(left, dp_budget * 2)  # more is left only where no document is as short as this table; see fit_budget
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in np.argsort(lengths, kind="stable"):
        length = int(lengths[i])
        most = min(int(counts[i] - taken[i]), left // length) if length else 0
        power = 1
        while most > 0:  # binary splitting: every count up to ``most`` is a sum of the parts
            part = min(power, most)
            steps.append((int(i), part, reach))
            reach |= (reach << (part * length)) & mask
            most -= part
            power *= 2
        if reach == mask:
            break
    at = reach.bit_length() - 1
    for i, part, earlier in reversed(steps):
        if not earlier >> at & 1:
            taken[i] += part
            at -= part * int(lengths[i])
    return filled(lengths, counts, taken, budget)


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = DP_BUDGET, cells: int = CELLS, work: int = WORK) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to ``budget`` or just below.

    A fine fit first (see ``fine_fit``), which meets the budget wherever some documents are short.  If it misses, as it can
    with few long documents, the subset sum of all of it in units, and a fine fit of what that leaves; the better
    of the two counts.  What stays open is less than the shortest document not taken, whatever the budget.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    taken = fine_fit(lengths, counts, budget, dp_budget)
    if budget <= 0 or int((taken * lengths).sum()) == budget or (taken == counts)[lengths > 0].all():
        return taken
    coarse = coarse_fit(lengths, counts, budget, cells, work)
    coarse = coarse + fine_fit(lengths, counts - coarse, budget - int((coarse * lengths).sum()), dp_budget)
    return coarse if int((coarse * lengths).sum()) > int((taken * lengths).sum()) else taken


def source_targets(sizes: DataFrame, weights=(1.0, 2.0, 3.0), max_repeats: float = 3.0) -> DataFrame:
    """(source, source_size) with a target for each.

    Sources by code point, nulls last, weigh ``weights``, repeating.  A target is min(cap, level * weight)
    with the one level at which all targets add up to all words; that is where resharing the excess ends.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.select("source", "source_size", pick.alias("weight"))
    cap = F.col("source_size") * F.lit(float(max_repeats))
    by_room = W.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    after = by_room.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = ranked.withColumn("cap", cap).withColumn("level", level)
    found = found.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("k"), "level"))).over(whole)["level"])
    return found.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def row_key():
    """Names a row by id, source and text; only rows that are the same document share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text"))


def mix_sources(docs: DataFrame, weights=(1.0, 2.0, 3.0), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    Sizes are words separated by ASCII white space.  A null or empty text has size 0 and takes 0; a null
    source is a source of its own, the last.  Repeated rows count as often as they occur; equal rows are
    ranked among themselves in any order, which no result can show.  An empty table gives an empty result.
    Only per-source and per-length counts are gathered, never documents; a source that holds most rows is
    split by the leading bits of the seeded hash, so choosing within it is spread over many tasks.  Targets pass
    through one task, a row a source.
    """
    return mixed(docs, weights, max_repeats, seed).drop("key")


def mixed(docs: DataFrame, weights, max_repeats: int, seed: int) -> DataFrame:
    """The rows of ``mix_sources`` with their ``key`` (see ``row_key``)."""
    # Hash and order go by the row's key: rows without an id are spread as well, and only rows that are the same document tie.
    seeded = F.xxhash64(F.lit(seed), row_key())
    base = cut(docs.select("doc_id", row_key().alias("key"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), seeded.alias("h")))
    lengths = base.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = cut(source_targets(sizes, weights, max_repeats).withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.floor((F.col("target") + 1e-6) / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("long")))
    budget = F.when(F.col("passes") < max_repeats, F.floor(F.col("target") - F.col("passes") * F.col("source_size") + 0.5)).otherwise(0).cast("long")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        pdf["k"] = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["budget"].iloc[0]))
        return pdf[["source", "size", "k"]]

    wanted = (
        lengths.join(targets.select(F.col("source").alias("s"), budget.alias("budget")), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "size", "n", "budget").groupBy("source").applyInPandas(fit, "source string, size long, k long")
    )
    bucket = F.shiftrightunsigned("h", 54)
    rooms = base.groupBy("source", "size", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    upto = W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    rooms = rooms.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    same = [F.col("source").eqNullSafe(F.col("s2")), F.col("size") == F.col("z2")]
    shares = (
        rooms.join(wanted.select(F.col("source").alias("s2"), F.col("size").alias("z2"), "k"), same)
        .select(F.col("source").alias("s3"), F.col("size").alias("z3"), F.col("bucket").alias("b3"), F.greatest(F.lit(0), F.least("n", F.col("k") - F.col("before"))).alias("share"))
    )
    ranked = base.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy("h", "key")))
    chosen = ranked.join(shares, [F.col("source").eqNullSafe(F.col("s3")), F.col("size") == F.col("z3"), F.col("bucket") == F.col("b3")])
    chosen = chosen.select("doc_id", "key", "source", "size", (F.col("rank") <= F.col("share")).alias("extra"))
    targets = targets.withColumnRenamed("source", "s4")
    return chosen.join(targets, F.col("source").eqNullSafe(F.col("s4"))).select(
        "doc_id", "key", "source", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("extra").cast("long"))).alias("taken")
    )


def apply_mix(docs: DataFrame, weights=(1.0, 2.0, 3.0), max_repeats: int = 3, seed: int = 17, salts: int = 64) -> DataFrame:
    """``docs``, all columns, with every row as often as the mix takes it; rows without words are not taken.

    Rows of one id, source and text share out what the mix takes of them: each gets an equal part, and one of
    them what that leaves over.  Rows with a null id are told apart by their texts.
    """
    mix = mixed(docs, weights, max_repeats, seed).where("size > 0")
    plan = mix.groupBy(F.col("key").alias("plan_key")).agg(F.sum((F.col("taken") / F.col("size")).cast("long")).alias("times"), F.count("*").alias("rows")).where("times > 0")
    # Rows travel as one struct, so that no column of theirs can clash with those made here.
    packed = docs.select(row_key().alias("own_key"), F.struct("*").alias("row"))
    each = packed.join(plan.where("times >= rows"), F.col("own_key") == F.col("plan_key")).select("row", F.explode(F.sequence(F.lit(1), F.floor(F.col("times") / F.col("rows")).cast("int"))))
    over = packed.join(plan.where("times % rows > 0"), F.col("own_key") == F.col("plan_key")).dropDuplicates(["own_key"])
    over = over.withColumn("left_over", F.col("times") % F.col("rows")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.least(F.lit(salts), "left_over").cast("int") - 1)))
    copies = (F.floor(F.col("left_over") / salts) + (F.col("salt") < F.col("left_over") % salts).cast("long")).cast("int")
    over = over.repartition(F.col("own_key"), F.col("salt")).withColumn("copies", copies).select("row", F.explode(F.sequence(F.lit(1), "copies")))
    return each.select("row.*").unionByName(over.select("row.*"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
