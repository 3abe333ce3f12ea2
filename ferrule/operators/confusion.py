"""Dependency confusion: threats of a package from its timeline, name, activity and scores; features of its scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .enrich import behavioral_counts


def confusion_threats(packages: DataFrame) -> DataFrame:
    """(package, type, severity, confidence): a row per package and rule that holds.

    ``packages`` has package, scope_type, patterns (how many suspicious ones its name shows), days (between
    registration and first commit), timeline (risk level), recent_commits, ml (whether the scores count), above, at_risk,
    anomaly, threat_score, predictive_score and error.  Unknown days and commits count as 0.  A package without
    its dates (null timeline) has no threats; one whose analysis failed (an error) has the error's row alone.
    """
    days, commits = F.coalesce("days", F.lit(0.0)), F.coalesce("recent_commits", F.lit(0))
    ml, above, at_risk = (F.coalesce(c, F.lit(False)) for c in ("ml", "above", "at_risk"))
    slow, private, level = F.col("timeline") == "LOW", F.col("scope_type") == "PRIVATE", F.col("timeline")
    near = F.when(ml & above, F.least(F.lit(95.0), 70 + F.floor(F.col("threat_score") * 25 + 0.5))).otherwise(F.least(F.lit(95.0), F.greatest(F.lit(0.0), 60 + (30 - days) * 2)))

    def threat(holds: Column, kind: str, severity: Column, confidence: Column) -> Column:
        return F.when(holds, F.struct(F.lit(f"DEPENDENCY_CONFUSION_{kind}").alias("type"), severity.alias("severity"), confidence.cast("double").alias("confidence")))

    found = F.array(
        threat(~slow, "TIMELINE", level, near / 100),
        threat(slow & ml & above, "ML_ANOMALY", F.when(F.col("threat_score") >= 0.8, "HIGH").otherwise("MEDIUM"), F.col("threat_score") * 0.9),
        threat(slow & ml & at_risk & ~above, "PREDICTIVE_RISK", F.lit("LOW"), F.col("predictive_score") * 0.6),
        threat(F.col("patterns") > 0, "PATTERN", F.when(private, "HIGH").otherwise("MEDIUM"), F.lit(0.75)),
        threat(private, "SCOPE", F.lit("HIGH"), F.lit(0.85)),
        threat((commits < 5) & (days > 30), "ACTIVITY", F.lit("MEDIUM"), F.lit(0.6)),
    )
    known = F.when(F.col("timeline").isNotNull(), F.filter(found, lambda t: t.isNotNull()))
    failed = F.array(threat(F.lit(True), "ERROR", F.lit("LOW"), F.lit(0.1)))
    return packages.select("package", F.explode(F.when(F.col("error").isNotNull(), failed).otherwise(known)).alias("t_")).select("package", "t_.*")


def script_features(manifests: DataFrame, scripts: str = "scripts", dependencies: str = "dependencies", dev: str = "dev_dependencies") -> DataFrame:
    """``manifests`` with measures of its scripts and dependencies, three maps (A42); a missing map is an empty one."""
    empty = F.create_map().cast("map<string,string>")
    own, size = F.coalesce(scripts, empty), lambda c: F.size(F.coalesce(c, empty)).cast("long")
    text = lambda key: F.try_element_at(own, F.lit(key))
    length = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    hook = F.coalesce(text("postinstall"), text("install"))
    counted = manifests.withColumn("all_scripts_", F.array_join(F.map_values(own), "\n"))
    out = counted.select(
        *manifests.columns, size(scripts).alias("script_count"), F.aggregate(F.map_values(own), F.lit(0).cast("long"), lambda n, s: n + F.coalesce(F.length(s), F.lit(0))).alias("script_length"),
        F.coalesce(F.length(hook) > 0, F.lit(False)).alias("has_postinstall"), length(hook).alias("postinstall_length"), length(text("preinstall")).alias("preinstall_length"),
        length(text("postuninstall")).alias("postuninstall_length"), size(dependencies).alias("dependency_count"), size(dev).alias("dev_dependency_count"), *behavioral_counts("all_scripts_"),
    )
    proxy = F.col("obfuscation_count") * 0.05 + F.col("base64_decode_count") * 0.05 + F.col("eval_count") * 0.1
    return out.withColumn("entropy_score", F.least(F.lit(1.0), proxy))
