"""Queries of reports, trends, comparisons and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import relate, risk, windows
from ..registry import query, table
from .standins import THREATS_SQL, threats

NOW = "TIMESTAMP '1998-08-02 00:00:00'"


@query("composite_risk_by_scan", f"SELECT scan_id, {risk.RISK_SQL} FROM (SELECT *, {risk.SCORE_SQL} AS c, {risk.CATEGORY_SQL} AS category FROM {THREATS_SQL}) GROUP BY scan_id")
def composite_risk_by_scan(spark, d):
    return risk.composite_risk(threats(spark, d), ["scan_id"])


@query("composite_risk_by_org", f"""
SELECT o_custkey AS org, {risk.RISK_SQL} FROM (SELECT o_custkey, t.*, {risk.SCORE_SQL} AS c, {risk.CATEGORY_SQL} AS category FROM {THREATS_SQL} t JOIN orders ON o_orderkey = scan_id) GROUP BY o_custkey""")
def composite_risk_by_org(spark, d):
    scans = table(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("org"))
    return risk.composite_risk(threats(spark, d).join(scans, "scan_id"), ["org"])


@query("severity_counts", f"SELECT severity, count(*)::BIGINT AS n FROM {THREATS_SQL} GROUP BY severity")
def severity_counts(spark, d):
    return threats(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


@query("severity_filter", f"SELECT scan_id, ord, severity, round(confidence, 6) AS confidence FROM {THREATS_SQL} WHERE severity IN ('CRITICAL', 'HIGH')")
def severity_filter(spark, d):
    return threats(spark, d).where(F.col("severity").isin("CRITICAL", "HIGH")).select("scan_id", "ord", "severity", F.round("confidence", 6).alias("confidence"))


RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


@query("threat_ranking", f"SELECT scan_id, ord, severity, round(confidence, 6) AS confidence FROM {THREATS_SQL} ORDER BY {RANK}, confidence DESC, scan_id, ord")
def threat_ranking(spark, d):
    """All threats, the gravest last, and the surest first among equals (O1)."""
    ordered = threats(spark, d).orderBy(risk.severity_rank(F.col("severity")), F.desc("confidence"), "scan_id", "ord")
    return ordered.select("scan_id", "ord", "severity", F.round("confidence", 6).alias("confidence"))


@query("gravest_threats", f"SELECT scan_id, ord, severity, round(confidence, 6) AS confidence FROM {THREATS_SQL} ORDER BY {RANK} DESC, confidence DESC, scan_id, ord LIMIT 100")
def gravest_threats(spark, d):
    """The hundred gravest, a top-k report."""
    ordered = threats(spark, d).orderBy(F.desc(risk.severity_rank(F.col("severity"))), F.desc("confidence"), "scan_id", "ord").limit(100)
    return ordered.select("scan_id", "ord", "severity", F.round("confidence", 6).alias("confidence"))


@query("executive_grouping_sets", f"""
SELECT severity, type, package, count(*)::BIGINT AS n, grouping(severity)::BIGINT AS g_severity, grouping(type)::BIGINT AS g_type, grouping(package)::BIGINT AS g_package
FROM {THREATS_SQL} GROUP BY GROUPING SETS ((severity), (type), (package), ())""")
def executive_grouping_sets(spark, d):
    """All totals of the executive view (A3) in one pass."""
    threats(spark, d).createOrReplaceTempView("ferrule_threats")
    return spark.sql("""
        SELECT severity, type, package, count(*) AS n, cast(grouping(severity) AS bigint) AS g_severity, cast(grouping(type) AS bigint) AS g_type, cast(grouping(package) AS bigint) AS g_package
        FROM ferrule_threats GROUP BY GROUPING SETS ((severity), (type), (package), ())""")


@query("top_packages", f"SELECT package, count(*)::BIGINT AS n FROM {THREATS_SQL} GROUP BY package ORDER BY n DESC, package LIMIT 5")
def top_packages(spark, d):
    return threats(spark, d).groupBy("package").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "package").limit(5)


@query("top_types", f"SELECT type, count(*)::BIGINT AS n FROM {THREATS_SQL} GROUP BY type ORDER BY n DESC, type LIMIT 10")
def top_types(spark, d):
    return threats(spark, d).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(10)


@query("trends_by_day", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(DISTINCT o_orderkey)::BIGINT AS scans, count(CASE WHEN o_orderstatus = 'F' THEN l_orderkey END)::BIGINT AS threats
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def trends_by_day(spark, d):
    """Scans of every status and threats of completed scans by day (A4); threats are counted per scan before the join."""
    scans = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    joined = scans.join(found, "o_orderkey", "left")
    return joined.groupBy("day").agg(F.count("*").alias("scans"), F.sum(F.when(F.col("o_orderstatus") == "F", F.coalesce("n", F.lit(0))).otherwise(0)).alias("threats"))


@query("compliance_coverage", f"""
WITH s AS (SELECT o_orderkey AS scan_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10),
r AS (SELECT scan_id, {risk.RISK_SQL} FROM (SELECT *, {risk.SCORE_SQL} AS c, {risk.CATEGORY_SQL} AS category FROM {THREATS_SQL} SEMI JOIN s USING (scan_id)) GROUP BY scan_id),
m AS (SELECT coalesce(confidentiality, 0) AS confidentiality, coalesce(integrity, 0) AS integrity, coalesce(availability, 0) AS availability, (SELECT count(*) FROM s) AS n FROM s LEFT JOIN r USING (scan_id))
SELECT k AS category, round(sum(1 - v) / max(n) * 100, 4) AS coverage, round(sum(1 - v) / max(n) * 100, 4) < 80 AS gap
FROM (SELECT unnest(['confidentiality', 'integrity', 'availability']) AS k, unnest([confidentiality, integrity, availability]) AS v, n FROM m) GROUP BY k""")
def compliance_coverage(spark, d, n: int = 10):
    """Mean uncovered risk by category over the ``n`` newest scans (A5), which are few enough to broadcast; a scan without threats is wholly covered."""
    newest = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(n).select(F.col("o_orderkey").alias("scan_id"))
    by_scan = risk.composite_risk(threats(spark, d).join(F.broadcast(newest), "scan_id"), ["scan_id"])
    every = newest.join(by_scan, "scan_id", "left")
    rows = every.select(F.explode(F.create_map(*[x for k in fixed.CATEGORY_WEIGHTS for x in (F.lit(k), F.coalesce(k, F.lit(0.0)))])).alias("category", "v"))
    return rows.groupBy("category").agg(F.round(F.sum(1 - F.col("v")) / F.count("*") * 100, 4).alias("coverage")).withColumn("gap", F.col("coverage") < 80)


def controls_sql(table_: list) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(type, '{w}')" for w in ws) + f" THEN '{c}'" for c, ws in table_[:-1])
    return f"CASE {cases} ELSE '{table_[-1][0]}' END"


@query("compliance_controls", f"SELECT type, {controls_sql(fixed.SOC2_CONTROLS)} AS soc2, {controls_sql(fixed.ISO_CONTROLS)} AS iso, count(*)::BIGINT AS n FROM {THREATS_SQL} GROUP BY type")
def compliance_controls(spark, d):
    counts = threats(spark, d).groupBy("type").agg(F.count("*").alias("n"))
    return counts.select("type", risk.controls(F.col("type"), fixed.SOC2_CONTROLS).alias("soc2"), risk.controls(F.col("type"), fixed.ISO_CONTROLS).alias("iso"), "n")


@query("scan_page", "SELECT o_orderkey, o_orderdate::TIMESTAMP AS created_at, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20")
def scan_page(spark, d):
    """A page of scans, newest first (O2)."""
    page = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(50)
    return page.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("created_at"), "o_orderstatus")


@query("tenant_scans", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def tenant_scans(spark, d):
    """Scans of one tenant (P13); the filter reaches the scan."""
    return table(spark, d, "orders").where("o_custkey = 7").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus")


@query("recent_scans", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= {NOW} - INTERVAL 2000 DAY AND contains(lower(o_orderpriority), 'urgent')")
def recent_scans(spark, d):
    """Scans by status, age and target (P14); the time is a parameter."""
    return table(spark, d, "orders").where(f"o_orderstatus = 'F' AND o_orderdate >= {NOW} - INTERVAL 2000 DAYS AND contains(lower(o_orderpriority), 'urgent')").select("o_orderkey", "o_orderstatus")


@query("scan_search", f"""
SELECT scan_id, ord, CASE WHEN contains(lower(type), 'mal') THEN 'type' WHEN contains(lower(p_name), 'mal') THEN 'package' ELSE 'message' END AS matched
FROM {THREATS_SQL} JOIN part ON p_partkey = package WHERE contains(lower(type), 'mal') OR contains(lower(p_name), 'mal') OR contains(lower(severity || ' in ' || p_brand), 'mal')
UNION ALL SELECT o_orderkey, 0::BIGINT, 'target' FROM orders WHERE contains(lower(o_orderpriority), 'mal')""")
def scan_search(spark, d, needle: str = "mal"):
    """A needle in threat types, packages, messages and scan targets, the first match named."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("package"), "p_name", "p_brand")
    rows = threats(spark, d).join(part, "package")
    has = lambda c: F.lower(c).contains(needle)
    matched = F.when(has(F.col("type")), "type").when(has(F.col("p_name")), "package").when(has(F.concat("severity", F.lit(" in "), "p_brand")), "message")
    found = rows.select("scan_id", "ord", matched.alias("matched")).where("matched IS NOT NULL")
    scans = table(spark, d, "orders").where(has(F.col("o_orderpriority"))).select(F.col("o_orderkey").alias("scan_id"), F.lit(0).cast("long").alias("ord"), F.lit("target").alias("matched"))
    return found.unionByName(scans)


COMPARE = "SELECT {c} AS side, type, package FROM (SELECT type, package, bool_or(scan_id % 2 = 0) AS a, bool_or(scan_id % 2 = 1) AS b FROM " + THREATS_SQL + " GROUP BY type, package) WHERE {w}"


def compared(spark, d):
    rows = threats(spark, d)
    return relate.compare_sets(rows.where("scan_id % 2 = 0"), rows.where("scan_id % 2 = 1"), ["type", "package"])


@query("scan_compare_only_a", COMPARE.format(c="'only_a'", w="a AND NOT b"))
def scan_compare_only_a(spark, d):
    return compared(spark, d).where("side = 'only_a'")


@query("scan_compare_both", COMPARE.format(c="'both'", w="a AND b"))
def scan_compare_both(spark, d):
    return compared(spark, d).where("side = 'both'")


@query("scan_compare_only_b", COMPARE.format(c="'only_b'", w="b AND NOT a"))
def scan_compare_only_b(spark, d):
    return compared(spark, d).where("side = 'only_b'")


@query("scan_detail_join", f"""
SELECT o_orderkey, c_name, count(*)::BIGINT AS threats, count(CASE WHEN severity = 'CRITICAL' THEN 1 END)::BIGINT AS critical
FROM orders JOIN customer ON c_custkey = o_custkey JOIN {THREATS_SQL} ON scan_id = o_orderkey GROUP BY o_orderkey, c_name""")
def scan_detail_join(spark, d):
    """Scans with owners and threat counts (J9, J10) in one plan; threats are counted before the join."""
    counts = threats(spark, d).groupBy(F.col("scan_id").alias("o_orderkey")).agg(F.count("*").alias("threats"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(counts, "o_orderkey").join(owners, "o_custkey").drop("o_custkey")


@query("json_props_extract", "SELECT event_type, count(*)::BIGINT AS n, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS total, count(DISTINCT (props::JSON ->> 'k')::BIGINT)::BIGINT AS kinds FROM events GROUP BY event_type")
def json_props_extract(spark, d):
    """Typed fields out of a JSON column; text that isn't JSON gives null."""
    n = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.count_distinct(n).alias("kinds"))


@query("history_severity_totals", f"""
SELECT severity, sum(n)::BIGINT AS total FROM (SELECT scan_id, severity, count(*) AS n FROM {THREATS_SQL} GROUP BY scan_id, severity)
WHERE scan_id IN (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 14) GROUP BY severity""")
def history_severity_totals(spark, d):
    """Severity totals of the last fourteen scans from their count maps."""
    last = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(14).select(F.col("o_orderkey").alias("scan_id"))
    counts = threats(spark, d).join(F.broadcast(last), "scan_id", "left_semi").groupBy("scan_id", "severity").agg(F.count("*").alias("n"))
    maps = counts.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("m"))
    return maps.select(F.explode("m").alias("severity", "n")).groupBy("severity").agg(F.sum("n").alias("total"))


@query("history_bars", """
WITH h AS (SELECT o_orderdate, count(*)::BIGINT AS n FROM orders GROUP BY o_orderdate ORDER BY o_orderdate DESC LIMIT 14)
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, n, floor(n / (SELECT greatest(1, max(n)) FROM h) * 20 + 0.5)::BIGINT AS bar FROM h""")
def history_bars(spark, d):
    """Bars of the last fourteen days, scaled to the largest."""
    days = table(spark, d, "orders").groupBy("o_orderdate").agg(F.count("*").alias("n")).orderBy(F.desc("o_orderdate")).limit(14)
    return windows.share_of_max(days.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "n"), F.col("n"))


@query("error_stats", """
SELECT event_type, user_id, count(*)::BIGINT AS n, grouping(event_type)::BIGINT AS g_type, grouping(user_id)::BIGINT AS g_user FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())""")
def error_stats(spark, d):
    """Errors by type, by context and in all."""
    table(spark, d, "events").createOrReplaceTempView("ferrule_events")
    return spark.sql("SELECT event_type, user_id, count(*) AS n, cast(grouping(event_type) AS bigint) AS g_type, cast(grouping(user_id) AS bigint) AS g_user FROM ferrule_events GROUP BY GROUPING SETS ((event_type), (user_id), ())")


@query("most_common_error", "SELECT event_type, n FROM (SELECT event_type, count(*)::BIGINT AS n, min(ts) AS first FROM events GROUP BY event_type) ORDER BY n DESC, first LIMIT 1")
def most_common_error(spark, d):
    """The most frequent type, the earlier on ties."""
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).select("event_type", "n")


@query("queue_stats", "SELECT user_id, sum(value)::DOUBLE AS total, round(avg(value), 6) AS mean, max(value) AS top, least(0.0, min(value)) AS low, count(*)::BIGINT AS n FROM (SELECT user_id, round(value, 3) AS value FROM events) GROUP BY user_id")
def queue_stats(spark, d):
    """Sum, mean, maximum and minimum with the minimum seeded at 0."""
    rows = table(spark, d, "events").select("user_id", F.round("value", 3).alias("value"))
    return rows.groupBy("user_id").agg(F.sum("value").alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"), F.least(F.lit(0.0), F.min("value")).alias("low"), F.count("*").alias("n"))


@query("cache_ratios", """
SELECT user_id, round(count(CASE WHEN event_type = 'click' THEN 1 END) / nullif(count(*), 0), 6) AS hit_ratio, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY user_id""")
def cache_ratios(spark, d):
    """Hits over requests per layer and each layer's share."""
    rows = table(spark, d, "events")
    total = rows.agg(F.count("*").alias("all_"))
    per = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("hits"))
    return per.crossJoin(F.broadcast(total)).select("user_id", F.round(F.try_divide("hits", "n"), 6).alias("hit_ratio"), F.round(F.col("n") / F.col("all_"), 6).alias("share"))


@query("cache_trend", """
WITH r AS (SELECT user_id, round(value, 3) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events),
m AS (SELECT user_id, round(avg(CASE WHEN p <= 10 THEN value END), 6) AS recent, round(avg(CASE WHEN p > 10 THEN value END), 6) AS previous FROM r WHERE p <= 20 GROUP BY user_id)
SELECT *, CASE WHEN recent - previous > 0.05 THEN 'improving' WHEN recent - previous < -0.05 THEN 'degrading' ELSE 'stable' END AS trend FROM m""")
def cache_trend(spark, d):
    return windows.band_trend(table(spark, d, "events").select("user_id", "event_id", F.round("value", 3).alias("value")), ["user_id"], "value", "event_id")


@query("provider_stats", "SELECT l_partkey AS package, count(*)::BIGINT AS total, count(DISTINCT l_suppkey)::BIGINT AS providers, count(DISTINCT l_orderkey)::BIGINT AS ids, list_sort(list(DISTINCT l_returnflag)) AS modes FROM lineitem GROUP BY l_partkey")
def provider_stats(spark, d):
    """Advisories grouped by package: totals, distinct ids and providers."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("package")).agg(
        F.count("*").alias("total"), F.count_distinct("l_suppkey").alias("providers"), F.count_distinct("l_orderkey").alias("ids"), F.array_sort(F.collect_set("l_returnflag")).alias("modes")
    )


@query("distinct_types", f"SELECT scan_id, list_sort(list(DISTINCT type)) AS types, count(DISTINCT package)::BIGINT AS packages FROM {THREATS_SQL} GROUP BY scan_id")
def distinct_types(spark, d):
    """Distinct types and packages of each scan."""
    return threats(spark, d).groupBy("scan_id").agg(F.array_sort(F.collect_set("type")).alias("types"), F.count_distinct("package").alias("packages"))


@query("directory_totals", "SELECT page_id, len(string_split(regexp_replace(url, '^https?://', ''), '/'))::BIGINT AS weight FROM pages")
def directory_totals(spark, d):
    """Path depth as a weight."""
    return table(spark, d, "pages").select("page_id", F.size(F.split(F.regexp_replace("url", "^https?://", ""), "/")).cast("long").alias("weight"))


@query("weights_sum", f"SELECT round({' + '.join(str(w) for w in fixed.ML_WEIGHTS.values())}, 6)::DOUBLE AS total")
def weights_sum(spark, d):
    """The sum of configured weights."""
    weights = F.create_map(*[x for k, w in fixed.ML_WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    return spark.range(1).select(F.round(F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("consensus_vote", """
SELECT user_id, event_type AS winner, n AS votes, n >= 2 AS agreed FROM (
  SELECT user_id, event_type, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1""")
def consensus_vote(spark, d):
    """The most frequent answer, the first on ties."""
    votes = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    best = votes.groupBy("user_id").agg(F.max_by(F.struct("event_type", "n"), F.struct("n", (-F.col("first")).alias("m"))).alias("v"))
    return best.select("user_id", F.col("v.event_type").alias("winner"), F.col("v.n").alias("votes"), (F.col("v.n") >= 2).alias("agreed"))


@query("rate_window_counts", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)::BIGINT AS in_window FROM events""")
def rate_window_counts(spark, d):
    return windows.trailing_count(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 3600).select("event_id", "in_window")


@query("minute_bucket_cap", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 100""")
def minute_bucket_cap(spark, d):
    return windows.minute_cap(table(spark, d, "events").select("event_id", "event_type", "ts"), ["event_type"], "ts", ["ts", "event_id"], 100).select("event_id")


@query("request_batches", """
WITH a AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 3600000000 THEN 1 ELSE 0 END AS f FROM events),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM a),
c AS (SELECT *, ((row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // 20)::BIGINT AS part FROM b)
SELECT user_id, run, part, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS n FROM c GROUP BY user_id, run, part""")
def request_batches(spark, d):
    return windows.gap_batches(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", 3_600_000, 20, "event_id")


TRUST = "CASE WHEN event_type = 'purchase' THEN 'verify' WHEN event_type = 'error' OR value > 80 THEN 'fail' ELSE 'ok' END"


@query("trust_fold", f"""
WITH e AS (SELECT user_id, {TRUST} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
l AS (SELECT user_id, max(CASE WHEN kind <> 'ok' THEN n END) AS last_set, count(*)::BIGINT AS events FROM e GROUP BY user_id)
SELECT l.user_id, round(least(1.0, CASE WHEN last_set IS NULL THEN 0.8 WHEN e.kind = 'verify' THEN 1.0 ELSE 0.3 END + 0.1 * (events - coalesce(last_set, 1)))::DOUBLE, 6) AS trust, events
FROM l LEFT JOIN e ON e.user_id = l.user_id AND e.n = l.last_set""")
def trust_fold(spark, d):
    rows = table(spark, d, "events").select("user_id", F.expr(TRUST).alias("kind"), "ts", "event_id")
    return windows.trust_fold(rows, ["user_id"], "kind", ["ts", "event_id"])


@query("audit_by_org", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 500")
def audit_by_org(spark, d):
    """Newest audit entries of one tenant."""
    return table(spark, d, "events").where("user_id = 3").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "user_id", "event_type")


@query("unread_notifications", "SELECT user_id, count(*)::BIGINT AS unread FROM events WHERE event_type IN ('click', 'purchase') AND ts > (SELECT min(ts) + INTERVAL 10 DAY FROM events) GROUP BY user_id")
def unread_notifications(spark, d):
    """Finished events after the last one seen."""
    rows = table(spark, d, "events").select("user_id", "event_type", "ts")
    seen = rows.agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("seen"))
    return rows.where(F.col("event_type").isin("click", "purchase")).join(F.broadcast(seen), F.col("ts") > F.col("seen")).groupBy("user_id").agg(F.count("*").alias("unread"))


@query("request_priority", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 20")
def request_priority(spark, d):
    """The next batch by priority."""
    return table(spark, d, "orders").orderBy("o_orderpriority", "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")


@query("dedup_first", "SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_first(spark, d):
    """The first row of each key."""
    return relate.keep_first(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("per_group_caps", f"SELECT scan_id, ord FROM (SELECT scan_id, ord, row_number() OVER (PARTITION BY scan_id ORDER BY ord) AS rn FROM {THREATS_SQL}) WHERE rn <= 3")
def per_group_caps(spark, d):
    """The first rows of each scan in manifest order (W5, O8, O11): the cap is the operator."""
    return relate.first_n(threats(spark, d).select("scan_id", "ord"), ["scan_id"], ["ord"], 3)


@query("union_all_stages", f"SELECT stage, count(*)::BIGINT AS n FROM (SELECT 'static' AS stage FROM {THREATS_SQL} WHERE ord <= 3 UNION ALL SELECT 'advisory' FROM {THREATS_SQL} WHERE ord > 3) GROUP BY stage")
def union_all_stages(spark, d):
    """Threats of several stages in one table."""
    rows = threats(spark, d)
    parts = rows.where("ord <= 3").select(F.lit("static").alias("stage"), "severity").unionByName(rows.where("ord > 3").select(F.lit("advisory").alias("stage"), "type"), allowMissingColumns=True)
    return parts.groupBy("stage").agg(F.count("*").alias("n"))

