"""Queries of names, versions, advisories, timelines, scripts, commits and documentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions import versions as V
from ..operators import enrich, relate, validate
from ..registry import query, table
from ..session import parts_for
from . import sqltext as S
from .detection import rounded

NAME = "CASE WHEN p_size % 3 = 0 THEN '@' || lower(replace(p_brand, '#', '-')) || '/' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN 'malware-' WHEN p_size % 11 = 0 THEN 'lodahs' WHEN p_size % 13 = 0 THEN 'expres' ELSE '' END || CASE WHEN p_size % 11 = 0 OR p_size % 13 = 0 THEN '' ELSE replace(p_name, ' ', '-') END"
VERSION = "(p_partkey % 3)::VARCHAR || '.' || (p_partkey % 10)::VARCHAR || '.' || (p_size)::VARCHAR || CASE WHEN p_size % 9 = 0 THEN '-beta' ELSE '' END"
RANGE = "CASE p_size % 5 WHEN 0 THEN '*' WHEN 1 THEN '>=1.0.0 <2.5.0' WHEN 2 THEN '<=1.5' WHEN 3 THEN '>0.9.1' ELSE '< 2.0.0' END"


def packages(spark, d):
    """Parts as packages with a name, a version and a wanted range."""
    version = F.expr(VERSION.replace("::VARCHAR", ""))
    return table(spark, d, "part").select("p_partkey", "p_size", F.expr(NAME).alias("name"), version.alias("version"), F.expr(RANGE).alias("wanted"), "p_brand", "p_retailprice")


PACKAGES = f"(SELECT p_partkey, p_size, {NAME} AS name, {VERSION} AS version, {RANGE} AS wanted, p_brand, p_retailprice FROM part)"


def similarity_sql(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE (greatest(length({a}), length({b})) - levenshtein({a}, {b})) / greatest(length({a}), length({b})) END"


SIMILAR = "greatest(0.0, " + ", ".join(similarity_sql("unscoped", f"'{p}'") for p in fixed.POPULAR_PACKAGES) + ")"
UNSCOPED = "CASE WHEN starts_with(name, '@') THEN coalesce(string_split(name, '/')[2], name) ELSE name END"


@query("name_similarity", f"SELECT p_partkey, round({SIMILAR}, 6)::DOUBLE AS similarity FROM (SELECT p_partkey, name AS unscoped FROM {PACKAGES})")
def name_similarity(spark, d):
    return packages(spark, d).select("p_partkey", F.round(enrich.popular_similarity(F.col("name")), 6).alias("similarity"))


@query("package_name_analysis", f"""
SELECT p_partkey, scoped, scope, unscoped, suspicious_patterns, similarity, CASE WHEN len(suspicious_patterns) > 0 THEN 'HIGH' WHEN similarity > 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN NOT scoped THEN 'PUBLIC' WHEN {S.any_match('name', fixed.PRIVATE_SCOPES)} THEN 'PRIVATE' ELSE 'UNKNOWN' END AS scope_type
FROM (SELECT *, round({SIMILAR}, 6)::DOUBLE AS similarity FROM (
  SELECT p_partkey, name, starts_with(name, '@') AS scoped, CASE WHEN starts_with(name, '@') THEN string_split(name, '/')[1] END AS scope, {UNSCOPED} AS unscoped,
    list_filter([{', '.join(f"CASE WHEN regexp_matches(name, {S.quoted(p)}) THEN {i}::BIGINT END" for i, p in enumerate(fixed.SUSPICIOUS_NAMES, 1))}], lambda x: x IS NOT NULL) AS suspicious_patterns FROM {PACKAGES}))""")
def package_name_analysis(spark, d):
    found = enrich.name_analysis(packages(spark, d).select("p_partkey", "name"))
    return found.drop("name")


@query("dependency_checks", f"""
SELECT p_partkey, finding, severity, confidence FROM (
  SELECT p_partkey, unnest(['suspicious_keyword', 'suspicious_name', 'suspicious_version', 'permissive_version']) AS finding, unnest(['MEDIUM', 'HIGH', 'HIGH', 'MEDIUM']) AS severity, unnest([0.7, 0.8, 0.8, 0.6])::DOUBLE AS confidence,
    unnest([contains(lower(name), 'malware') OR contains(lower(name), 'virus') OR contains(lower(name), 'trojan') OR contains(lower(name), 'backdoor'), contains(lower(name), 'malware') OR contains(lower(name), 'virus') OR contains(lower(name), 'trojan'), regexp_matches(v, 'http://|git://|file://'), starts_with(v, '*') OR starts_with(v, '^0.') OR starts_with(v, '~0.')]) AS hit
  FROM (SELECT p_partkey, name, CASE p_size % 6 WHEN 0 THEN '*.1' WHEN 1 THEN '^0.' || version WHEN 2 THEN 'git://host/' || name ELSE version END AS v FROM {PACKAGES})) WHERE hit""")
def dependency_checks(spark, d):
    version = F.when(F.col("p_size") % 6 == 0, "*.1").when(F.col("p_size") % 6 == 1, F.concat(F.lit("^0."), "version")).when(F.col("p_size") % 6 == 2, F.concat(F.lit("git://host/"), "name")).otherwise(F.col("version"))
    deps = packages(spark, d).select("p_partkey", "name", version.alias("v"))
    return enrich.dependency_checks(deps, "name", "v").drop("name", "v")


def parts_sql(v: str) -> str:
    return f"list_transform(string_split({v}, '.'), lambda x: coalesce(try_cast(x AS DOUBLE), 0.0))"


def compare_sql(a: str, b: str) -> str:
    return (
        f"coalesce(sign(list_filter(list_transform(range(1, greatest(len(string_split({a}, '.')), len(string_split({b}, '.'))) + 1), "
        f"lambda i: coalesce(({parts_sql(a)})[i], 0.0) - coalesce(({parts_sql(b)})[i], 0.0)), lambda d: d <> 0)[1]), 0)::INTEGER"
    )


@query("version_compare", f"SELECT p_partkey, {compare_sql('version', chr(39) + '1.5.20' + chr(39))} AS sign, regexp_replace(wanted, '^[\\^~>=<]+\\s*', '') AS cleaned FROM {PACKAGES}")
def version_compare(spark, d):
    return packages(spark, d).select("p_partkey", V.compare(F.col("version"), F.lit("1.5.20")).alias("sign"), V.clean(F.col("wanted")).alias("cleaned"))


def range_sql(v: str, token: str) -> str:
    return (
        f"CASE WHEN {token} = '*' THEN true WHEN starts_with({token}, '>=') THEN {compare_sql(v, f'trim(substr({token}, 3))')} >= 0 WHEN starts_with({token}, '<=') THEN {compare_sql(v, f'trim(substr({token}, 3))')} <= 0 "
        f"WHEN starts_with({token}, '>') THEN {compare_sql(v, f'trim(substr({token}, 2))')} > 0 WHEN starts_with({token}, '<') THEN {compare_sql(v, f'trim(substr({token}, 2))')} < 0 ELSE true END"
    )


@query("version_range_join", f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, p.p_partkey FROM lineitem JOIN {PACKAGES} p ON p.p_partkey = l_partkey
SEMI JOIN (SELECT p_partkey AS k, bool_and({range_sql('version', 't')}) AS ok FROM (SELECT p_partkey, version, unnest(string_split_regex(trim(wanted), '\\s+')) AS t FROM {PACKAGES}) GROUP BY p_partkey) r ON r.k = p.p_partkey AND r.ok""")
def version_range_join(spark, d):
    """Dependencies met by an advisory's range."""
    deps = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_partkey").alias("name"))
    own = packages(spark, d)
    versions = deps.join(own.select(F.col("p_partkey").alias("name"), "version"), "name")
    return relate.advisory_matches(versions, own.select(F.col("p_partkey").alias("name"), F.col("wanted").alias("affected"))).select("l_orderkey", "l_linenumber", F.col("name").alias("p_partkey"))


@query("version_bounds", f"""
SELECT p_partkey, {compare_sql('version', "'1.0.0'")} >= 0 AND {compare_sql('version', "'2.4.9'")} < 0 AS in_bounds,
  CASE WHEN wanted = '*' THEN true WHEN starts_with(wanted, '>=') THEN {compare_sql('version', 'trim(substr(wanted, 3))')} >= 0 WHEN starts_with(wanted, '<=') THEN {compare_sql('version', 'trim(substr(wanted, 3))')} <= 0 ELSE true END AS in_loose
FROM {PACKAGES}""")
def version_bounds(spark, d):
    """Bounds of two advisory dialects."""
    none = F.lit(None).cast("string")
    v = F.col("version")
    return packages(spark, d).select("p_partkey", V.in_bounds(v, F.lit("1.0.0"), none, none, F.lit("2.4.9")).alias("in_bounds"), V.in_loose_range(v, F.col("wanted")).alias("in_loose"))


@query("fixed_version", f"""
SELECT p_partkey, coalesce(nullif(regexp_extract(t, '(?i)(?:fixed in|patched in|resolved in)\\s+v?(\\d+\\.\\d+\\.\\d+)', 1), ''), nullif(regexp_extract(t, '(?i)prior to\\s+v?(\\d+\\.\\d+\\.\\d+)', 1), '')) AS fixed_in
FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Fixed in v' || version WHEN 1 THEN 'All releases prior to ' || version ELSE 'unknown' END AS t FROM {PACKAGES})""")
def fixed_version(spark, d):
    prose = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Fixed in v"), "version")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("All releases prior to "), "version")).otherwise("unknown")
    return packages(spark, d).select("p_partkey", V.fixed_in(prose).alias("fixed_in"))


FEED = "SELECT l_partkey AS package, CASE WHEN l_linenumber % 2 = 0 THEN 'SUSPICIOUS_DEPENDENCY' ELSE 'MALICIOUS_CODE' END AS type, " + S.SEVERITY + " AS severity, round(1 - l_discount, 2)::DOUBLE AS confidence, 'V' || (l_suppkey % 20) AS vulnerability, l_orderkey * 10 + l_linenumber AS ord FROM lineitem WHERE {w}"
RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


@query("advisory_merge", f"""
WITH e AS ({FEED.format(w="l_returnflag = 'R'")}), f0 AS ({FEED.format(w="l_returnflag <> 'R'")}),
f AS (SELECT * EXCLUDE (rn) FROM (SELECT f0.*, row_number() OVER (PARTITION BY package, vulnerability ORDER BY ord) AS rn FROM f0 ANTI JOIN e USING (package, vulnerability)) WHERE rn = 1),
t AS (SELECT package, min(ord) AS ord FROM e WHERE type = 'SUSPICIOUS_DEPENDENCY' GROUP BY package),
s AS (SELECT t.package, t.ord AS target, e.severity, e.confidence, {RANK.replace('severity', 'e.severity', 1)} AS r FROM t JOIN e ON e.package = t.package AND e.ord = t.ord),
x AS (SELECT f.package, f.severity, f.confidence, {RANK.replace('severity', 'f.severity', 1)} AS r, s.r AS r0, s.severity AS s0, s.confidence AS c0,
  max({RANK.replace('severity', 'f.severity', 1)}) OVER (PARTITION BY f.package ORDER BY f.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f JOIN s USING (package)),
u AS (SELECT package, arg_max(severity, r) AS severity, greatest(max(c0), max(confidence)) AS confidence FROM x WHERE r > greatest(r0, coalesce(before, 0)) GROUP BY package)
SELECT e.package, e.type, coalesce(CASE WHEN e.ord = t.ord THEN u.severity END, e.severity) AS severity, coalesce(CASE WHEN e.ord = t.ord THEN u.confidence END, e.confidence) AS confidence, e.vulnerability, e.ord
FROM e LEFT JOIN t ON t.package = e.package LEFT JOIN u ON u.package = e.package
UNION ALL SELECT package, type, severity, confidence, vulnerability, ord FROM f ANTI JOIN t USING (package)""")
def advisory_merge(spark, d):
    lines = table(spark, d, "lineitem")
    rows = lines.select(
        F.col("l_partkey").alias("package"), F.when(F.col("l_linenumber") % 2 == 0, "SUSPICIOUS_DEPENDENCY").otherwise("MALICIOUS_CODE").alias("type"), F.expr(S.SEVERITY).alias("severity"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.concat(F.lit("V"), (F.col("l_suppkey") % 20).cast("string")).alias("vulnerability"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "l_returnflag",
    )
    return relate.merge_advisories(rows.where("l_returnflag = 'R'").drop("l_returnflag"), rows.where("l_returnflag <> 'R'").drop("l_returnflag"), parts_for(lines))


@query("registry_first_created", "SELECT o_custkey, arg_min(created, pos) AS created, min(pos)::BIGINT AS pos FROM (SELECT o_custkey, o_orderdate AS created, o_orderkey AS pos FROM orders WHERE o_orderstatus <> 'P') GROUP BY o_custkey")
def registry_first_created(spark, d):
    """The first registry in order that knows the package."""
    rows = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("created"), F.col("o_orderkey").alias("pos"))
    return relate.first_by_order(rows, ["o_custkey"], "created", "pos")


@query("nearest_ancestor", """
WITH p AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages), m AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:1], '/') AS dir FROM p WHERE length(path) % 2 = 0 UNION SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') FROM p WHERE length(path) % 3 = 0)
SELECT path, arg_max(dir, n) AS manifest_dir FROM (SELECT path, unnest(range(1, greatest(1, len(string_split(path, '/')) - 1) + 1)) AS n, string_split(path, '/') AS s FROM p) LEFT JOIN m ON m.dir = array_to_string(s[1:n], '/') GROUP BY path""")
def nearest_ancestor(spark, d):
    paths = table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    top = lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/")
    manifests = paths.where("length(path) % 2 = 0").select(top(1).alias("dir")).unionByName(paths.where("length(path) % 3 = 0").select(top(2).alias("dir")))
    return relate.nearest_ancestor(paths, manifests, "path", "dir")


@query("manifest_overlay", """
SELECT p_partkey, unnest(map_keys(m)) AS dep, unnest(map_values(m)) AS version FROM (
  SELECT p_partkey, map_from_entries([{'k': 'a', 'v': '1'}, {'k': CASE WHEN p_size % 2 = 0 THEN 'b' ELSE 'c' END, 'v': CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END}]) AS m FROM part)""")
def manifest_overlay(spark, d):
    """Dependencies and development dependencies as one map, the latter winning."""
    first = F.create_map(F.lit("a"), F.lit("1"), F.when(F.col("p_size") % 2 == 0, "b").otherwise("c"), F.lit("old"))
    second = F.create_map(F.when(F.col("p_size") % 2 == 0, "b").otherwise("c"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")))
    return table(spark, d, "part").select("p_partkey", F.explode(relate.overlay_maps(first, second)).alias("dep", "version"))


@query("rule_overlay", """
SELECT coalesce(b.name, c.name) AS name, coalesce(c.severity, b.severity) AS severity, coalesce(c.threshold, b.threshold) AS threshold
FROM (SELECT p_name AS name, max(p_brand) AS severity, max(p_size)::BIGINT AS threshold FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name) b
FULL JOIN (SELECT p_name AS name, max(p_type) AS severity, NULL::BIGINT AS threshold FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name) c ON b.name = c.name""")
def rule_overlay(spark, d):
    part = table(spark, d, "part")
    base = part.where("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("name")).agg(F.max("p_brand").alias("severity"), F.max("p_size").cast("long").alias("threshold"))
    custom = part.where("p_partkey % 3 = 0").groupBy(F.col("p_name").alias("name")).agg(F.max("p_type").alias("severity"), F.lit(None).cast("long").alias("threshold"))
    return relate.overlay(base, custom, "name", ["severity", "threshold"])


@query("threat_substring_join", "SELECT p_partkey, r_name, count(*)::BIGINT AS n FROM (SELECT p_partkey, lower(p_name || ' ' || p_brand || ' ' || CASE WHEN p_size % 4 = 0 THEN 'asia' WHEN p_size % 4 = 1 THEN 'Europe and Africa' ELSE '' END) AS hay FROM part) JOIN region ON contains(hay, lower(r_name)) GROUP BY ALL")
def threat_substring_join(spark, d):
    """Threat text that names a package."""
    tail = F.when(F.col("p_size") % 4 == 0, "asia").when(F.col("p_size") % 4 == 1, "Europe and Africa").otherwise("")
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", tail).alias("message"))
    return relate.mentions(rows, F.col("message"), table(spark, d, "region"), "r_name").groupBy("p_partkey", "r_name").agg(F.count("*").alias("n"))


@query("good_packages_anti", "SELECT p_partkey FROM part ANTI JOIN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) ON l_partkey = p_partkey")
def good_packages_anti(spark, d):
    """Packages without code threats."""
    bad = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return relate.without(table(spark, d, "part").select("p_partkey"), bad, ["p_partkey"])


DAYS = "abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000"


@query("timeline_risk", f"""
SELECT l_orderkey, n, round(days, 6) AS days, CASE WHEN days <= 1 THEN 'CRITICAL' WHEN days <= 3 THEN 'HIGH' WHEN days <= 7 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  round(least(1.0, CASE WHEN days <= 1 THEN 0.5 WHEN days <= 7 THEN 0.35 WHEN days <= 30 THEN 0.2 ELSE 0.0 END + CASE WHEN commits < 1 THEN 0.2 WHEN commits < 5 THEN 0.1 ELSE 0.0 END + CASE WHEN conflict THEN 0.2 ELSE 0.0 END)::DOUBLE, 6) AS anomaly
FROM (SELECT l_orderkey, l_linenumber::BIGINT AS n, {DAYS} AS days, l_linenumber - 1 AS commits, l_tax > 0.06 AS conflict FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")
def timeline_risk(spark, d):
    created = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = table(spark, d, "lineitem").join(created, "l_orderkey").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), enrich.days_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("days"), (F.col("l_tax") > 0.06).alias("c"))
    score = enrich.timeline_anomaly(F.col("days"), F.col("n") - 1, F.col("c"))
    return rows.select("l_orderkey", "n", F.round("days", 6).alias("days"), enrich.timeline_level(F.col("days")).alias("level"), F.round(score, 6).alias("anomaly"))


@query("maintenance_score", """
SELECT o_orderkey, (CASE WHEN d <= 7 THEN 1.0 WHEN d <= 30 THEN 0.9 WHEN d <= 90 THEN 0.7 WHEN d <= 180 THEN 0.5 WHEN d <= 365 THEN 0.3 ELSE 0.1 END)::DOUBLE AS maintenance
FROM (SELECT o_orderkey, (epoch_us(TIMESTAMP '1998-08-02') - epoch_us(o_orderdate)) / 86400000000 AS d FROM orders)""")
def maintenance_score(spark, d):
    since = (F.unix_micros(F.lit("1998-08-02").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 86_400_000_000
    return table(spark, d, "orders").select("o_orderkey", enrich.maintenance(since).alias("maintenance"))


@query("popularity_score", """
SELECT s_suppkey, round(least(1.0, 0.5 * least(1.0, CASE WHEN dl > 0 THEN log10(dl + 1) ELSE 0 END / 6) + 0.3 * CASE WHEN stars IS NULL THEN 0.5 ELSE least(1.0, stars / 10000) END + 0.2 * CASE WHEN deps IS NULL THEN 0.5 ELSE least(1.0, deps / 100) END)::DOUBLE, 6) AS popularity
FROM (SELECT s_suppkey, floor(s_acctbal) * 10 AS dl, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS stars, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey * 5.0 END AS deps FROM supplier)""")
def popularity_score(spark, d):
    stars, deps = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey") * 5.0)
    return table(spark, d, "supplier").select("s_suppkey", F.round(enrich.popularity(F.floor("s_acctbal") * 10, stars, deps), 6).alias("popularity"))


MEASURES = "SELECT p_partkey, p_brand, p_size::DOUBLE AS script_count, length(p_name)::DOUBLE AS script_length, floor(p_retailprice)::DOUBLE AS dependency_count, (p_size % 8) / 8.0 AS entropy_score FROM part"


#: Mean and variance of the three typical packages, in SQL.
USUAL = {m: (sum(p[m] for p in fixed.TYPICAL_PACKAGES) / 3, sum((p[m] - sum(q[m] for q in fixed.TYPICAL_PACKAGES) / 3) ** 2 for p in fixed.TYPICAL_PACKAGES) / 3) for m in fixed.TYPICAL_PACKAGES[0]}


def z_sql(m: str, none: str, cap: str | None) -> str:
    """Distance from the mean of the other rows of the group, by a join with them."""
    mean = f"CASE WHEN count(o.p_partkey) = 0 THEN {USUAL[m][0]}::DOUBLE ELSE avg(o.{m}) END"
    var = f"CASE WHEN count(o.p_partkey) = 0 THEN {USUAL[m][1]}::DOUBLE ELSE var_pop(o.{m}) END"
    z = f"abs(any_value(p.{m}) - {mean}) / CASE WHEN {var} > 1e-12 THEN sqrt({var}) ELSE {none} END"
    return f"least({cap}, {z})" if cap else z


@query("cross_package_anomaly", f"""
WITH m AS (SELECT p_partkey, p_brand || '-' || p_partkey % 40 AS kind, script_count, script_length, dependency_count, entropy_score::DOUBLE AS entropy_score FROM ({MEASURES}))
SELECT p.p_partkey, round(least(1.0, ({z_sql('script_count', '0.001', None)} + {z_sql('script_length', '1.0', '3.0')} + {z_sql('dependency_count', '0.001', None)} + {z_sql('entropy_score', '0.001', None)}) / 4 / 3), 6)::DOUBLE AS cross_package_anomaly
FROM m p LEFT JOIN m o ON o.kind = p.kind AND o.p_partkey <> p.p_partkey GROUP BY p.p_partkey""")
def cross_package_anomaly(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", F.concat("p_brand", F.lit("-"), (F.col("p_partkey") % 40).cast("string")).alias("kind"), F.col("p_size").cast("double").alias("script_count"), F.length("p_name").cast("double").alias("script_length"),
        F.floor("p_retailprice").cast("double").alias("dependency_count"), ((F.col("p_size") % 8) / 8.0).alias("entropy_score"),
    )
    return rounded(enrich.cross_package_anomaly(rows, "kind").select("p_partkey", "cross_package_anomaly"), "cross_package_anomaly")


@query("behavioral_counts", f"SELECT page_id, {', '.join(f'len(regexp_extract_all(html, {S.quoted(p)}))::BIGINT AS {k}_count' for k, p in fixed.BEHAVIORS.items())} FROM pages")
def behavioral_counts(spark, d):
    return table(spark, d, "pages").select("page_id", *enrich.behavioral_counts("html"))


@query("behavioral_anomaly", """
SELECT p_partkey, round(least(1.0, CASE WHEN p_size % 2 = 0 AND p_size * 20 > 500 THEN 0.3 ELSE 0.0 END + CASE WHEN length(p_name) > 5 THEN 0.2 ELSE 0.0 END + CASE WHEN p_size % 5 > 2 THEN 0.2 ELSE 0.0 END + CASE WHEN p_size / 50 > 0.7 THEN 0.3 ELSE 0.0 END)::DOUBLE, 6) AS behavioral_anomaly FROM part""")
def behavioral_anomaly(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(enrich.behavioral_anomaly(size % 2 == 0, size * 20, F.length("p_name"), size % 5, size / 50), 6).alias("behavioral_anomaly"))


WORDS, PHRASES, MOODS = ["the", "of", "and", "idiot", "rights"], [r"all\s+rights\s+reserved", r"of\s+the", r"and\s+the\s+of"], ["idiot", "clown", "scum"]


@query("nlp_score", f"""
SELECT doc_id, keyword_count, phrases, round(greatest(0.0, 0.5 - ({' + '.join(f"CASE WHEN contains(lower(t), '{w}') THEN 0.1 ELSE 0.0 END" for w in MOODS)}))::DOUBLE, 6) AS sentiment,
  round(least(1.0, (least(1.0, keyword_count * 0.1) + least(1.0, len(phrases) * 0.2)) / 2)::DOUBLE, 6) AS nlp_score
FROM (SELECT doc_id, coalesce(text, '') AS t, ({' + '.join(f"len(regexp_extract_all(coalesce(text, ''), '(?i){chr(92)}b{w}{chr(92)}b'))" for w in WORDS)})::BIGINT AS keyword_count,
  list_sort(list_distinct(list_filter([{', '.join(f"trim(regexp_extract(coalesce(text, ''), {S.quoted('(?i)' + p)}))" for p in PHRASES)}], lambda x: x <> ''))) AS phrases FROM documents)""")
def nlp_score(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return enrich.nlp_scores(docs, "t", WORDS, PHRASES, MOODS).drop("t")


@query("issue_label_counts", """
SELECT conv_id, count(CASE WHEN regexp_matches(lower(text), 'security|vulnerab|the') THEN 1 END)::BIGINT AS labels, count(*)::BIGINT AS issues FROM conversations GROUP BY conv_id""")
def issue_label_counts(spark, d):
    """Issues with security words."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.lower("text").rlike("security|vulnerab|the")).alias("labels"), F.count("*").alias("issues"))


@query("author_share", "SELECT conv_id, count(*)::BIGINT AS authors, sum(n)::BIGINT AS commits, round(max(n) / sum(n), 6)::DOUBLE AS dominant_share FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def author_share(spark, d):
    return enrich.author_share(table(spark, d, "conversations"), "conv_id", "role")


ODD = " OR ".join(f"regexp_matches(m, {S.quoted(p)})" for p in fixed.SUSPICIOUS_MESSAGES)


@query("message_anomaly", f"""
SELECT conv_id, count(CASE WHEN m <> '' AND ({ODD}) THEN 1 END)::BIGINT AS suspicious, count(CASE WHEN m = '' THEN 1 END)::BIGINT AS empty, round(least(1.0, count(CASE WHEN m = '' OR {ODD} THEN 1 END) / count(*) * 1.5), 6)::DOUBLE AS message_anomaly
FROM (SELECT conv_id, CASE turn % 4 WHEN 0 THEN 'wip' WHEN 1 THEN '' ELSE trim(coalesce(text, '')) END AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 20 GROUP BY conv_id""")
def message_anomaly(spark, d):
    m = F.when(F.col("turn") % 4 == 0, "wip").when(F.col("turn") % 4 == 1, "").otherwise(F.trim(F.coalesce("text", F.lit(""))))
    return enrich.message_anomaly(table(spark, d, "conversations").select("conv_id", "turn", m.alias("m")), "conv_id", "m", "turn")


@query("diff_stats", """
WITH c AS (SELECT l_suppkey, l_orderkey, sum(floor(l_quantity) * 30)::BIGINT AS a, sum(floor(l_quantity) * 12)::BIGINT AS d FROM lineitem GROUP BY l_suppkey, l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC) AS rn FROM c),
s AS (SELECT l_suppkey, count(*) AS n, count(CASE WHEN d > 500 OR a > 2000 THEN 1 END)::BIGINT AS large_commits, floor(avg(a) + 0.5)::BIGINT AS avg_added, floor(avg(d) + 0.5)::BIGINT AS avg_deleted FROM r WHERE rn <= 10 AND a + d > 0 GROUP BY l_suppkey)
SELECT l_suppkey, large_commits, avg_added, avg_deleted, round(least(1.0, large_commits / n * 0.5 + CASE WHEN avg_deleted > 300 THEN 0.3 ELSE 0.0 END), 6)::DOUBLE AS diff_anomaly FROM s""")
def diff_stats(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", (F.floor("l_quantity") * 30).alias("a"), (F.floor("l_quantity") * 12).alias("d"))
    return enrich.diff_stats(rows, "l_suppkey", "l_orderkey", "a", "d")


ACTIVITY = "epoch_us(TIMESTAMP '1998-08-02') - epoch_us(o_orderdate)"


@query("commit_activity", f"""
SELECT o_custkey, count(*)::BIGINT AS commits, min(o_orderdate) AS first_commit, max(o_orderdate) AS last_commit, round((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000, 6)::DOUBLE AS range_days,
  count(CASE WHEN {ACTIVITY} <= 30 * 86400000000 THEN 1 END)::BIGINT AS recent_30, count(CASE WHEN {ACTIVITY} <= 90 * 86400000000 THEN 1 END)::BIGINT AS recent_90 FROM orders GROUP BY o_custkey""")
def commit_activity(spark, d):
    return enrich.commit_activity(table(spark, d, "orders").select("o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", F.lit("1998-08-02"))


@query("commit_pattern_score", f"""
WITH a AS (SELECT o_custkey, count(*) AS authors, sum(n) AS commits, max(n) / sum(n) AS share FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey),
b AS (SELECT o_custkey, (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000 AS days, count(CASE WHEN {ACTIVITY} <= 90 * 86400000000 THEN 1 END) AS r FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(least(1.0, CASE WHEN authors <= 1 THEN 0.2 ELSE 0.0 END + CASE WHEN commits < 10 THEN 0.2 ELSE 0.0 END + CASE WHEN days < 30 THEN 0.2 ELSE 0.0 END + CASE WHEN r < 3 THEN 0.15 ELSE 0.0 END + CASE WHEN share > 0.95 AND authors > 1 THEN 0.1 ELSE 0.0 END)::DOUBLE, 6) AS score FROM a JOIN b USING (o_custkey)""")
def commit_pattern_score(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate")
    activity = enrich.commit_activity(orders, "o_custkey", "o_orderdate", F.lit("1998-08-02")).drop("commits")
    joined = enrich.author_share(orders, "o_custkey", "o_orderpriority").join(activity, "o_custkey")
    score = enrich.commit_pattern_score(*[F.col(c) for c in ("authors", "commits", "range_days", "recent_90", "dominant_share")])
    return joined.select("o_custkey", F.round(score, 6).alias("score"))


PATHS = "(SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '../' || p_name WHEN 1 THEN '/etc/passwd' WHEN 2 THEN p_name || '; rm' WHEN 3 THEN '/proc/$(x)' ELSE p_brand END AS path FROM part)"


@query("path_validate", f"""
SELECT path, threat, severity, confidence FROM (SELECT path, unnest(['PATH_VALIDATION_ERROR', 'PATH_TRAVERSAL', 'COMMAND_INJECTION'{", 'PATH_VALIDATION_ERROR'" * len(validate.BLOCKED)}]) AS threat, unnest(['MEDIUM', 'HIGH', 'CRITICAL'{", 'HIGH'" * len(validate.BLOCKED)}]) AS severity,
  unnest([0.7, 0.9, 0.8{', 0.9' * len(validate.BLOCKED)}])::DOUBLE AS confidence, unnest([length(path) > 4096, {S.any_match('path', validate.TRAVERSAL, '(?i)')}, {S.any_match('path', validate.INJECTION)}, {', '.join(f"contains(path, {S.quoted(b)})" for b in validate.BLOCKED)}]) AS hit FROM {PATHS}) WHERE hit""")
def path_validate(spark, d):
    path = F.expr("CASE p_size % 6 WHEN 0 THEN '../' || p_name WHEN 1 THEN '/etc/passwd' WHEN 2 THEN p_name || '; rm' WHEN 3 THEN '/proc/$(x)' ELSE p_brand END")
    return validate.path_threats(table(spark, d, "part").select(path.alias("path")), "path")


@query("validators", f"""
SELECT p_partkey, CASE WHEN length(trim(name)) = 0 THEN 'empty' WHEN length(name) > 214 THEN 'too long' WHEN regexp_matches(name, '\\.\\.') THEN 'dangerous' WHEN NOT regexp_matches(name, '^(@[a-z0-9~-][a-z0-9._~-]*/)?[a-z0-9~-][a-z0-9._~-]*$') THEN 'format' END AS name_error,
  regexp_matches(version, '^\\d+\\.\\d+\\.\\d+(-[0-9A-Za-z.-]+)?(\\+[0-9A-Za-z.-]+)?$') AS semver FROM {PACKAGES}""")
def validators(spark, d):
    return packages(spark, d).select("p_partkey", validate.package_name_error(F.col("name")).alias("name_error"), validate.is_semver(F.col("version")).alias("semver"))


@query("external_urls", "SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) <> '' AND NOT regexp_matches(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^(localhost|127\\.|10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|169\\.254\\.|0\\.)') AS external, NOT starts_with(url, '/') AND NOT contains(url, '..') AS safe FROM pages")
def external_urls(spark, d):
    return table(spark, d, "pages").select("page_id", validate.is_external_url(F.col("url")).alias("external"), validate.safe_entry(F.col("url")).alias("safe"))


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped, replace(replace(url, chr(10), ' '), '|', chr(92) || '|') AS cell FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_escape("html").alias("escaped"), T.markdown_escape("url").alias("cell"))


@query("sanitize_text", "SELECT doc_id, trim(substr(regexp_replace(text, '[\\x00-\\x1F\\x7F-\\x{9F}]', '', 'g'), 1, 1000)) AS clean FROM documents")
def sanitize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sanitize("text").alias("clean"))


@query("cid_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def cid_sha256(spark, d):
    """Content digests (F26); ``content_id`` adds the base-32 form."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
