"""Joins of a scanner's tables: advisories, registries, manifests, graphs of paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.versions import in_range
from .risk import severity_rank


def advisory_matches(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies (name, version) with the advisories (name, affected, ...) whose range holds the version.

    Each version of a name is tested once against each of its ranges; rows that repeat them are joined to what was found.
    """
    asked, offered = deps.select("name", "version").distinct(), advisories.select("name", "affected").distinct()
    hits = asked.join(offered, "name").where(in_range(F.col("version"), F.col("affected")))
    return deps.join(hits, ["name", "version"]).join(advisories, ["name", "affected"])


def merge_advisories(existing: DataFrame, found: DataFrame, parts: int | None = None) -> DataFrame:
    """Threats (package, type, severity, confidence, vulnerability, ord) merged with advisory threats of the same columns.

    Findings whose vulnerability and package are known already are skipped.  The first dependency threat of
    the same package, if there is one, takes the highest severity among the rest and the highest confidence
    of those that raised it, in order; otherwise the findings are added, one for each vulnerability.  Null packages and
    vulnerabilities equal nothing.  Both tables are dealt by package once, over ``parts`` partitions if given, and all that
    follows are windows within it that need two sorts: by vulnerability, and by the order of merging.
    """
    columns = ["package", "type", "severity", "confidence", "vulnerability", "ord"]
    both = existing.select(*columns, F.lit(False).alias("new_")).unionByName(found.select(*columns, F.lit(True).alias("new_")))
    both = both.repartition("package") if parts is None else both.repartition(parts, "package")
    # Known threats come first, so a finding that comes first is new and its vulnerability's first; with nulls it meets findings only.
    apart = F.col("new_") & (F.col("package").isNull() | F.col("vulnerability").isNull())
    fresh = F.col("new_") & (F.row_number().over(W.partitionBy("package", "vulnerability", apart).orderBy("new_", "ord")) == 1)
    kept = both.withColumn("fresh_", fresh).where("NOT new_ OR fresh_")
    dependency = ~F.col("new_") & F.col("type").isin("SUSPICIOUS_DEPENDENCY", "VULNERABLE_PACKAGE") & F.col("package").isNotNull()
    staged = kept.withColumn("stage_", F.when(dependency, 0).when(F.col("fresh_"), 1).otherwise(2)).withColumn("rank_", F.when(F.col("stage_") < 2, severity_rank(F.col("severity"))))
    # The target comes first and findings after it in order; those above all before them raise the severity and the confidence.
    merging = W.partitionBy("package").orderBy("stage_", "ord", "rank_", "severity", "confidence")
    ranked = staged.withColumn("target_", (F.col("stage_") == 0) & (F.row_number().over(merging) == 1))
    highest = F.max(F.when(F.col("target_") | F.col("fresh_"), F.col("rank_"))).over(merging.rowsBetween(W.unboundedPreceding, -1))
    raised = ranked.withColumn("counts_", F.col("target_") | (F.col("fresh_") & F.coalesce(F.col("rank_") > highest, F.lit(False))))
    whole = W.partitionBy("package")
    top = F.max(F.when(F.col("counts_"), F.struct("rank_", "severity"))).over(whole)["severity"]
    sure = F.max(F.when(F.col("counts_"), F.col("confidence"))).over(whole)
    merged = raised.select("*", F.max("target_").over(whole).alias("has_target_"), top.alias("top_"), sure.alias("sure_")).where("NOT fresh_ OR NOT has_target_")
    own = lambda name, new: F.when(F.col("target_"), F.col(new)).otherwise(F.col(name)).alias(name)
    return merged.select("package", "type", own("severity", "top_"), own("confidence", "sure_"), "vulnerability", "ord")


def first_by_order(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per key the first non-null value in order."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))


def keep_first(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("turn_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("turn_ = 1").drop("turn_")


def first_n(rows: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key (W5, W6, O11); Spark prunes each task's rows before the shuffle."""
    return rows.withColumn("turn_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("turn_") <= n).drop("turn_")


def nearest_ancestor(paths: DataFrame, manifests: DataFrame, path: str, directory: str) -> DataFrame:
    """For each path the deepest directory above it that holds a manifest (J15): ancestors exploded, an equi-join, and the deepest kept."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    exploded = paths.select(path, F.posexplode(above).alias("depth_", "dir_"))
    found = exploded.join(manifests.select(F.col(directory).alias("dir_")).distinct(), "dir_")
    best = found.groupBy(path).agg(F.max_by("dir_", "depth_").alias("manifest_dir"))
    return paths.select(path).distinct().join(best, path, "left")


def mentions(rows: DataFrame, text: Column, names: DataFrame, name: str, limit: int = 10_000) -> DataFrame:
    """Rows joined to every name that their lower-cased text contains.

    Names are broadcast in blocks of about ``limit``, so that any number of them is matched as substrings
    within bounded memory.
    """
    few = names.select(name).distinct()
    blocks = max(1, -(-few.count() // limit))
    block = F.pmod(F.xxhash64(name), F.lit(blocks))
    hay = rows.withColumn("hay_", F.lower(text))
    found = [hay.join(F.broadcast(few.where(block == k)), F.expr(f"contains(hay_, lower({name}))")) for k in range(blocks)]
    return reduce(DataFrame.unionByName, found).drop("hay_")


def compare_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of only a, only b, or both, as ``side`` (J8, U3): one aggregation instead of three joins."""
    both = a.select(*keys, F.lit(1).alias("in_")).unionByName(b.select(*keys, F.lit(2).alias("in_")))
    sides = both.groupBy(*keys).agg(F.bit_or("in_").alias("in_"))
    return sides.select(*keys, F.when(F.col("in_") == 1, "only_a").when(F.col("in_") == 2, "only_b").otherwise("both").alias("side"))


def overlay(base: DataFrame, custom: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Custom rows over base rows, field by field."""
    left, right = base.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), custom.select(key, *[F.col(f).alias(f"c_{f}") for f in fields])
    return left.join(right, key, "full").select(key, *[F.coalesce(f"c_{f}", f"b_{f}").alias(f) for f in fields])


def overlay_maps(first: Column, second: Column) -> Column:
    """Two maps as one in which the second wins."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k)), second)


def without(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")
