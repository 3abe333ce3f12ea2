"""Window-shaped measures: rates, buckets, batches, folds, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def trailing_count(events: DataFrame, keys: list[str], ts: str, seconds: int, name: str = "in_window") -> DataFrame:
    """Per event, events of its key in the trailing seconds up to it."""
    span = W.partitionBy(*keys).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn(name, F.count("*").over(span))


def minute_cap(events: DataFrame, keys: list[str], ts: str, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` events of each key and minute."""
    turn = W.partitionBy(*keys, F.date_trunc("minute", ts)).orderBy(*order)
    return events.withColumn("turn_", F.row_number().over(turn)).where(F.col("turn_") <= cap).drop("turn_")


def gap_batches(events: DataFrame, keys: list[str], ts: str, gap_ms: int, size: int, tie: str) -> DataFrame:
    """Batches that end after a quiet gap or at ``size`` events (R4): (keys, batch, start, end, n)."""
    order = W.partitionBy(*keys).orderBy(ts, tie)
    fresh = F.when(micros(ts) - micros(F.lag(ts).over(order)) >= gap_ms * 1000, 1).otherwise(0)
    marked = events.withColumn("new_", fresh)
    marked = marked.withColumn("run_", F.sum("new_").over(order.rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy(*keys, "run_").orderBy(ts, tie)) - 1
    return marked.withColumn("part_", F.floor(place / size)).groupBy(*keys, F.col("run_").cast("long").alias("run"), F.col("part_").cast("long").alias("part")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n")
    )


def trust_fold(events: DataFrame, keys: list[str], kind: str, order: list[str]) -> DataFrame:
    """Trust of each key after all its events in order (R6): verify sets 1, a failed scan 0.3, a good scan adds 0.1 up to 1, or sets 0.8 at first.

    Only events after the last one that sets the value matter, and they add up, so one window and one
    aggregation do without a fold over a collected list.
    """
    ranked = W.partitionBy(*keys).orderBy(*order)
    numbered = events.withColumn("n_", F.row_number().over(ranked))
    last = numbered.groupBy(*keys).agg(
        F.max_by(kind, F.when(F.col(kind) != "ok", F.col("n_"))).alias("setter_"), F.max(F.when(F.col(kind) != "ok", F.col("n_"))).alias("at_"), F.count("*").alias("n_all_")
    )
    base = F.when(F.col("at_").isNull(), 0.8).when(F.col("setter_") == "verify", 1.0).otherwise(0.3)
    goods = F.col("n_all_") - F.coalesce("at_", F.lit(1))
    return last.select(*keys, F.round(F.least(F.lit(1.0), base + 0.1 * goods), 6).alias("trust"), F.col("n_all_").alias("events"))


def band_trend(series: DataFrame, keys: list[str], value: str, order: str, band: int = 10, margin: float = 0.05) -> DataFrame:
    """Mean of the last ``band`` values against that of the band before."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    ranked = series.withColumn("p_", place).where(F.col("p_") <= 2 * band)
    means = ranked.groupBy(*keys).agg(F.round(F.avg(F.when(F.col("p_") <= band, F.col(value))), 6).alias("recent"), F.round(F.avg(F.when(F.col("p_") > band, F.col(value))), 6).alias("previous"))
    change = F.col("recent") - F.col("previous")
    return means.withColumn("trend", F.when(change > margin, "improving").when(change < -margin, "degrading").otherwise("stable"))


def share_of_max(rows: DataFrame, value: Column, width: int = 20) -> DataFrame:
    """Bar widths against the largest value, which counts as 1 at least."""
    top = rows.agg(F.greatest(F.lit(1), F.max(value)).alias("top_"))
    return rows.crossJoin(F.broadcast(top)).withColumn("bar", F.floor(value / F.col("top_") * width + 0.5).cast("long")).drop("top_")


def running_sums(per: DataFrame, order: str, columns: list[str], buckets: int = 64) -> DataFrame:
    """``per`` with, for each column c, c + "_before_": the sum of c over all smaller values of ``order``, which is unique and not null.

    Values are dealt into ranges by approximate quantiles; each range is added up in order by itself, and what the ranges
    before it hold is added by broadcast (at most ``buckets`` + 1 rows), so no task sorts all values.
    """
    bounds = per.agg(F.percentile_approx(order, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 1000).alias("bounds_"))
    placed = per.crossJoin(F.broadcast(bounds)).withColumn("range_", F.size(F.filter("bounds_", lambda b: b <= F.col(order)))).drop("bounds_")
    held = placed.groupBy(F.col("range_").alias("of_")).agg(*[F.sum(c).alias(c) for c in columns])
    offsets = held.select("of_", *[F.coalesce(F.sum(c).over(W.orderBy("of_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_offset_") for c in columns])
    within = W.partitionBy("range_").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(offsets), F.col("range_") == F.col("of_"))
    return joined.select(*per.columns, *[(F.col(f"{c}_offset_") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_before_") for c in columns])


def time_split(rows: DataFrame, ts: str, tie: str, share: float) -> DataFrame:
    """The newest share of rows as validation (W8): n = max(1, min(n - 1, round(n * share))), halves to even.

    The border is found from counts per timestamp, so the rows themselves are never gathered to be ranked.
    """
    per = rows.groupBy(ts).agg(F.count("*").alias("c_"))
    per = running_sums(per.where(F.col(ts).isNotNull()), ts, ["c_"])
    n = rows.agg(F.count("*").alias("n_"), F.count(ts).alias("known_"))
    wanted = F.greatest(F.lit(1), F.least(F.col("n_") - 1, F.bround(F.col("n_") * share).cast("long")))
    after = F.col("known_") - F.col("c__before_") - F.col("c_")
    border = per.crossJoin(F.broadcast(n)).select(F.col(ts).alias("t_"), (wanted - after).alias("room_"))
    joined = rows.join(border, F.col(ts) == F.col("t_"))
    place = F.row_number().over(W.partitionBy(ts).orderBy(F.desc(tie)))
    return joined.withColumn("validation", place <= F.col("room_")).drop("t_", "room_")
