"""Package measures: names, dependencies, timelines, scripts, commits, documentation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import contains_any, matches, word_boundary


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length (F2); two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise((longest - F.levenshtein(a, b)) / longest)


def popular_similarity(name: Column) -> Column:
    """The highest similarity to a popular package (J7); the list is short, so it is unrolled."""
    return F.greatest(F.lit(0.0), *[similarity(name, F.lit(p)) for p in fixed.POPULAR_PACKAGES])


def name_analysis(packages: DataFrame, name: str = "name") -> DataFrame:
    """Scope, unscoped name, suspicious patterns by number, similarity, risk level and scope type."""
    n = F.col(name)
    scoped = n.startswith("@")
    unscoped = F.when(scoped, F.coalesce(F.try_element_at(F.split(n, "/"), F.lit(2)), n)).otherwise(n)
    numbers = F.filter(F.array(*[F.when(n.rlike(p), F.lit(i).cast("long")) for i, p in enumerate(fixed.SUSPICIOUS_NAMES, 1)]), lambda x: x.isNotNull())
    private = reduce(lambda a, b: a | b, [n.rlike(p) for p in fixed.PRIVATE_SCOPES])
    out = packages.withColumn("scoped", scoped).withColumn("scope", F.when(scoped, F.split(n, "/")[0])).withColumn("unscoped", unscoped)
    out = out.withColumn("suspicious_patterns", numbers).withColumn("similarity", F.round(popular_similarity(F.col("unscoped")), 6))
    level = F.when(F.size("suspicious_patterns") > 0, "HIGH").when(F.col("similarity") > 0.8, "MEDIUM").otherwise("LOW")
    return out.withColumn("risk_level", level).withColumn("scope_type", F.when(~scoped, "PUBLIC").when(private, "PRIVATE").otherwise("UNKNOWN"))


def dependency_checks(deps: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """A row per dependency and finding."""
    n, v = F.lower(F.col(name)), F.col(version)
    made = lambda hit, kind, severity, confidence: F.when(hit, F.struct(F.lit(kind).alias("finding"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
    found = F.array(
        made(contains_any(n, fixed.DEPENDENCY_KEYWORDS), "suspicious_keyword", "MEDIUM", 0.7),
        made(contains_any(n, fixed.SUSPICIOUS_NAME_WORDS), "suspicious_name", "HIGH", 0.8),
        made(v.rlike(r"http://|git://|file://"), "suspicious_version", "HIGH", 0.8),
        made(v.startswith("*") | v.startswith("^0.") | v.startswith("~0."), "permissive_version", "MEDIUM", 0.6),
    )
    return deps.select("*", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f_")).select(*deps.columns, "f_.*")


def days_between(a: Column, b: Column) -> Column:
    """Absolute difference in days and fractions."""
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 86_400_000_000


def timeline_level(days: Column) -> Column:
    return F.when(days <= fixed.TIMELINE_CRITICAL, "CRITICAL").when(days <= fixed.TIMELINE_HIGH, "HIGH").when(days <= fixed.TIMELINE_MEDIUM, "MEDIUM").otherwise("LOW")


def timeline_anomaly(days: Column, commits: Column, scope_conflict: Column) -> Column:
    """Young registration, little activity, scope conflict (F20); unknown days count as a year, unknown commits as none."""
    d, c = F.coalesce(days, F.lit(365.0)), F.coalesce(commits, F.lit(0))
    age = F.when(d <= 1, 0.5).when(d <= 7, 0.35).when(d <= 30, 0.2).otherwise(0.0)
    activity = F.when(c < 1, 0.2).when(c < 5, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), age + activity + F.when(scope_conflict, 0.2).otherwise(0.0))


def maintenance(days_since: Column) -> Column:
    """By days since the last update (F21); 0.5 if unknown."""
    return F.when(days_since.isNull(), 0.5).when(days_since <= 7, 1.0).when(days_since <= 30, 0.9).when(days_since <= 90, 0.7).when(days_since <= 180, 0.5).when(days_since <= 365, 0.3).otherwise(0.1)


def popularity(downloads: Column, stars: Column, dependents: Column) -> Column:
    """Downloads on a log scale, stars and dependents up to their limits (F22); unknown ones count half."""
    d = F.least(F.lit(1.0), F.when(downloads > 0, F.log10(downloads + 1)).otherwise(0.0) / 6)
    # The least of a number and null is the number, so unknown ones are asked for first.
    s = F.when(stars.isNull(), 0.5).otherwise(F.least(F.lit(1.0), stars / 10000))
    p = F.when(dependents.isNull(), 0.5).otherwise(F.least(F.lit(1.0), dependents / 100))
    return F.least(F.lit(1.0), 0.5 * d + 0.3 * s + 0.2 * p)


#: Measures of the anomaly score: the deviation that stands for none, and the cap of a score, if any.
ANOMALY_MEASURES = {"script_count": (0.001, None), "script_length": (1.0, 3.0), "dependency_count": (0.001, None), "entropy_score": (0.001, None)}


def cross_package_anomaly(packages: DataFrame, group: str) -> DataFrame:
    """Mean absolute z-score against the *other* packages of the group, thirds, capped at 1.

    Means and deviations without a row's own value come from the group's mean and centred squares, which Spark
    merges from partial ones, so there is no self-join and no loss of digits.  A package without others of its
    group is held against three typical ones.  Missing measures are 0.
    """
    own = {m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in ANOMALY_MEASURES}
    sums = packages.groupBy(F.col(group).alias("g_")).agg(F.count("*").alias("n_"), *[x for m, v in own.items() for x in (F.avg(v).alias(f"a_{m}"), F.var_pop(v).alias(f"v_{m}"))])
    joined = packages.join(sums, F.col(group).eqNullSafe(F.col("g_")))
    lone, others, scores = F.col("n_") == 1, F.col("n_") - 1, []
    for m, (none, cap) in ANOMALY_MEASURES.items():
        typical = [float(p[m]) for p in fixed.TYPICAL_PACKAGES]
        usual = sum(typical) / len(typical)
        spread = sum((x - usual) ** 2 for x in typical) / len(typical)
        off = own[m] - F.col(f"a_{m}")
        mean = F.when(lone, usual).otherwise(F.col(f"a_{m}") - off / others)
        variance = F.when(lone, spread).otherwise(F.greatest(F.lit(0.0), (F.col(f"v_{m}") * F.col("n_") - off * off) / others - off * off / others / others))
        z = F.abs(own[m] - mean) / F.when(variance > 1e-12, F.sqrt(variance)).otherwise(none)
        scores.append(F.least(F.lit(cap), z) if cap else z)
    total = reduce(lambda a, b: a + b, scores)
    return joined.select(*packages.columns, F.round(F.least(F.lit(1.0), total / len(scores) / 3), 6).alias("cross_package_anomaly"))


def behavioral_counts(content: str = "content") -> list[Column]:
    """Seven families of risky calls."""
    return [matches(content, p).cast("long").alias(f"{k}_count") for k, p in fixed.BEHAVIORS.items()]


def behavioral_anomaly(has_postinstall: Column, postinstall_length: Column, scripts: Column, rare: Column, entropy_score: Column) -> Column:
    """Points for long hooks, many scripts, rare dependencies and entropy."""
    point = lambda hit, p: F.when(F.coalesce(hit, F.lit(False)), p).otherwise(0.0)
    return F.least(F.lit(1.0), point(has_postinstall & (postinstall_length > 500), 0.3) + point(scripts > 5, 0.2) + point(rare > 2, 0.2) + point(entropy_score > 0.7, 0.3))


def nlp_scores(docs: DataFrame, text: str, keywords: list[str] | None = None, phrases: list[str] | None = None, negative: list[str] | None = None) -> DataFrame:
    """Security keywords, distinct phrases, sentiment and score of texts."""
    keywords, phrases, negative = keywords or fixed.SECURITY_KEYWORDS, phrases or fixed.SUSPICIOUS_PHRASES, negative or fixed.NEGATIVE_WORDS
    # Whole words exclude each other, so one pass counts them all; phrases are looked up where any occurs.
    single, others = [k for k in keywords if re.fullmatch(r"[A-Za-z0-9_]+", k)], [k for k in keywords if not re.fullmatch(r"[A-Za-z0-9_]+", k)]
    counts = [matches(text, f"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(single)})(?![A-Za-z0-9_])")] if single else []
    count = reduce(lambda a, b: a + b, [*counts, *[matches(text, word_boundary(rf"(?i)\b{k}\b")) for k in others]], F.lit(0))
    each = F.array(*[F.trim(F.regexp_extract(text, f"(?i){p}", 0)) for p in phrases])
    found = F.when(F.col(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in phrases)), F.array_distinct(F.filter(each, lambda x: x != ""))).otherwise(F.array().cast("array<string>"))
    mood = reduce(lambda a, b: a + b, [F.when(F.lower(text).contains(w), 0.1).otherwise(0.0) for w in negative])
    out = docs.withColumn("keyword_count", count.cast("long")).withColumn("phrases", F.array_sort(found))
    score = F.least(F.lit(1.0), (F.least(F.lit(1.0), F.col("keyword_count") * 0.1) + F.least(F.lit(1.0), F.size("phrases") * 0.2)) / 2)
    return out.withColumn("sentiment", F.round(F.greatest(F.lit(0.0), F.lit(0.5) - mood), 6)).withColumn("nlp_score", F.round(score, 6))


def nlp_evidence(scored: DataFrame) -> DataFrame:
    """Texts with score 0.5 or more and a phrase, MEDIUM from 0.7."""
    return scored.where((F.col("nlp_score") >= 0.5) & (F.size("phrases") > 0)).withColumn("severity", F.when(F.col("nlp_score") >= 0.7, "MEDIUM").otherwise("LOW"))


def author_share(commits: DataFrame, repo: str, author: str) -> DataFrame:
    """Authors, commits and the share of the one with most."""
    per = commits.groupBy(repo, author).agg(F.count("*").alias("c_"))
    return per.groupBy(repo).agg(F.count("*").alias("authors"), F.sum("c_").alias("commits"), F.round(F.max("c_") / F.sum("c_"), 6).alias("dominant_share"))


def last_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("turn_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("turn_") <= n).drop("turn_")


def message_anomaly(commits: DataFrame, repo: str, message: str, order: str, n: int = 20) -> DataFrame:
    """Empty and meaningless messages among the last ``n``."""
    text = F.trim(F.coalesce(F.col(message), F.lit("")))
    odd = reduce(lambda a, b: a | b, [text.rlike(p) for p in fixed.SUSPICIOUS_MESSAGES])
    rows = last_n(commits, [repo], [F.desc(order)], n)
    share = F.count_if((text == "") | odd) / F.count("*")
    return rows.groupBy(repo).agg(F.count_if((text != "") & odd).alias("suspicious"), F.count_if(text == "").alias("empty"), F.round(F.least(F.lit(1.0), share * 1.5), 6).alias("message_anomaly"))


def diff_stats(changes: DataFrame, repo: str, commit: str, added: str, deleted: str, n: int = 10) -> DataFrame:
    """Large and average changes of the last ``n`` commits."""
    per = changes.groupBy(repo, commit).agg(F.sum(added).alias("add_"), F.sum(deleted).alias("del_"))
    per = last_n(per, [repo], [F.desc(commit)], n).where("add_ + del_ > 0")
    sums = per.groupBy(repo).agg(F.count("*").alias("n_"), F.count_if((F.col("del_") > 500) | (F.col("add_") > 2000)).alias("large_commits"), F.floor(F.avg("add_") + 0.5).alias("avg_added"), F.floor(F.avg("del_") + 0.5).alias("avg_deleted"))
    score = F.least(F.lit(1.0), F.col("large_commits") / F.col("n_") * 0.5 + F.when(F.col("avg_deleted") > 300, 0.3).otherwise(0.0))
    return sums.select(repo, "large_commits", "avg_added", "avg_deleted", F.round(score, 6).alias("diff_anomaly"))


def commit_activity(commits: DataFrame, repo: str, ts: str, as_of: Column) -> DataFrame:
    """Commits, first and last, range in days, and those of the last 30 and 90 days (A10, T4: first is the earliest)."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000
    return commits.groupBy(repo).agg(
        F.count("*").alias("commits"), F.min(ts).alias("first_commit"), F.max(ts).alias("last_commit"), F.round(days_between(F.min(ts), F.max(ts)), 6).alias("range_days"),
        F.count_if(age <= 30).alias("recent_30"), F.count_if(age <= 90).alias("recent_90"),
    )


def commit_pattern_score(authors: Column, commits: Column, range_days: Column, recent_90: Column, share: Column) -> Column:
    """Points for few authors, commits, days and recent work (A13); 0.5 without history."""
    point = lambda hit, p: F.when(hit, p).otherwise(0.0)
    score = point(authors <= 1, 0.2) + point(commits < 10, 0.2) + point(range_days < 30, 0.2) + point(recent_90 < 3, 0.15) + point((share > 0.95) & (authors > 1), 0.1)
    return F.when(commits.isNull() | (commits == 0), 0.5).otherwise(F.least(F.lit(1.0), score))
