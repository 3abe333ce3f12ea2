"""Queries of changing tables, feedback, drift, provider blocks, options, targets and model gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import learn, report, store, validate
from ..registry import query, table
from . import sqltext as S

#: Line items as changes of scans: shipment sets the status, a return the error, big quantities the result.
CHANGE = {"status": "CASE WHEN l_linestatus = 'O' THEN 'completed' END", "error": "CASE WHEN l_returnflag = 'R' THEN 'returned ' || l_linenumber END", "result": "CASE WHEN l_quantity > 25 THEN l_partkey END"}


@query("scan_store", "SELECT l_orderkey, " + ", ".join(f"max({{'o': l_linenumber, 'v': {e}}}) FILTER (WHERE ({e}) IS NOT NULL)['v'] AS {k}" for k, e in CHANGE.items()) + " FROM lineitem GROUP BY l_orderkey")
def scan_store(spark, d):
    """The current row of every scan from its changes."""
    changes = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).alias(k) for k, e in CHANGE.items()])
    return store.current(changes, "l_orderkey", "l_linenumber", list(CHANGE))


STATE = "CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END"


@query("scan_states", f"""
WITH e AS (SELECT *, {STATE} AS s, row_number() OVER (PARTITION BY user_id, {STATE} IN ('completed', 'failed') ORDER BY event_id) AS n FROM events)
SELECT user_id, coalesce(max(s) FILTER (WHERE n = 1 AND s IN ('completed', 'failed')), CASE WHEN bool_or(s = 'running') THEN 'running' ELSE 'pending' END) AS status,
  min(ts) AS created_at, max(ts) FILTER (WHERE n = 1 AND s IN ('completed', 'failed')) AS completed_at FROM e GROUP BY user_id""")
def scan_states(spark, d):
    """The state that each user's events lead to."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.expr(STATE).alias("event"))
    return store.scan_states(rows, "user_id", "event", "event_id", "ts")


@query("scan_audit", f"""
WITH e AS (SELECT *, {STATE} AS s FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, s = 'running' ORDER BY event_id) AS n FROM e WHERE s <> 'pending')
SELECT user_id, CASE WHEN s = 'running' THEN 'scan.triggered' ELSE 'scan.completed' END AS action, ts AS created_at FROM f WHERE n = 1 AND s <> 'failed'""")
def scan_audit(spark, d):
    """The audit entries of the same events."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.expr(STATE).alias("event"))
    return store.scan_audit(rows, "user_id", "event", "event_id", "ts")


FEEDBACK = "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_partkey + 20 END AS package, l_linenumber - 1 AS label FROM lineitem"


@query("feedback_join", f"""
SELECT l_orderkey, l_linenumber, f.package, label::INTEGER AS label, brand FROM ({FEEDBACK}) f LEFT JOIN (SELECT p_partkey AS package, p_brand AS brand FROM part) p ON p.package = f.package
WHERE f.package IS NOT NULL AND label IN (0, 1)""")
def feedback_join(spark, d):
    """Feedback with its packages' metadata."""
    table(spark, d, "lineitem").createOrReplaceTempView("ferrule_lineitem")
    rows = spark.sql(FEEDBACK.replace("FROM lineitem", "FROM ferrule_lineitem"))
    return store.feedback_rows(rows, table(spark, d, "part").select(F.col("p_partkey").alias("package"), F.col("p_brand").alias("brand")))


@query("training_rows_new", """
WITH r AS (SELECT l_tax, l_discount, (l_linenumber % 2)::INTEGER AS label, l_linenumber FROM lineitem)
SELECT DISTINCT l_tax, l_discount, label FROM r WHERE l_linenumber > 2 AND (l_tax, l_discount, label) NOT IN (SELECT (l_tax, l_discount, label) FROM r WHERE l_linenumber = 1)""")
def training_rows_new(spark, d):
    """Features and labels that aren't known yet."""
    rows = table(spark, d, "lineitem").select("l_tax", "l_discount", (F.col("l_linenumber") % 2).cast("int").alias("label"), "l_linenumber")
    return store.new_training_rows(rows.where("l_linenumber = 1"), rows.where("l_linenumber > 2"), ["l_tax", "l_discount"]).drop("l_linenumber")


@query("package_labels", """
SELECT DISTINCT trim(p_brand) AS name, 0 AS label FROM part WHERE p_size < 20 UNION ALL SELECT DISTINCT trim(p_brand), 1 FROM part WHERE p_size > 45""")
def package_labels(spark, d):
    """The union of good and bad lists."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("name"), "p_size")
    return store.package_labels(part.where("p_size < 20"), part.where("p_size > 45"))


@query("score_drift", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events),
p AS (SELECT event_type, value, count(*) FILTER (WHERE n <= 500) AS b, count(*) FILTER (WHERE n > 100) AS a FROM r GROUP BY ALL HAVING b > 0 OR a > 0),
g AS (SELECT *, abs(sum(a) OVER w / nullif(sum(a) OVER k, 0) - sum(b) OVER w / nullif(sum(b) OVER k, 0)) AS gap FROM p WINDOW w AS (PARTITION BY event_type ORDER BY value NULLS FIRST ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY event_type))
SELECT event_type, sum(b)::BIGINT AS recent_count, sum(a)::BIGINT AS train_count, round(coalesce(max(gap), 0)::DOUBLE, 6) AS ks, round(coalesce(max(gap), 0)::DOUBLE, 6) >= 0.2 AS drifted FROM g GROUP BY event_type""")
def score_drift(spark, d):
    """The last 500 scores of each kind against those but the last 100."""
    rows = table(spark, d, "events").select("event_type", "event_id", "value")
    older = rows.join(store.recent_scores(rows, "event_type", "event_id", 100).select("event_id"), "event_id", "left_anti")
    return store.score_drift(store.recent_scores(rows, "event_type", "event_id"), older, "event_type", "value")


ERROR = "CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'status 403' WHEN event_type = 'error' THEN 'rate limit' WHEN event_type = 'signup' THEN 'timeout' END"


@query("provider_blocks", f"""
WITH e AS (SELECT user_id % 5 AS provider, event_id, ts, {ERROR} AS error FROM events),
u AS (SELECT *, last_value(CASE WHEN contains(error, '403') THEN ts + INTERVAL 1 HOUR WHEN contains(error, 'rate limit') THEN ts + INTERVAL 6 SECOND END IGNORE NULLS) OVER (PARTITION BY provider ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM e)
SELECT event_id, provider, coalesce(until > ts, false) AS blocked FROM u""")
def provider_blocks(spark, d):
    """Calls that meet a provider's block."""
    rows = table(spark, d, "events").select((F.col("user_id") % 5).alias("provider"), "event_id", "ts", F.expr(ERROR).alias("error"))
    return store.provider_blocks(rows, "provider", "ts", "event_id", "error").select("event_id", "provider", "blocked")


AT = ["CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END", "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL '5' DAY END", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + make_interval(0, 0, 0, CAST(o_custkey % 9 AS INT)) END"]
AT_SQL = [*AT[:2], "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_days((o_custkey % 9)::INTEGER) END"]


@query("timeline_events", "SELECT o_orderkey, place, type, \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY \"at\", p) - 1 AS place FROM (" + " UNION ALL ".join(
    f"SELECT o_orderkey, {a} AS \"at\", '{k}' AS type, {i} AS p FROM orders WHERE ({a}) IS NOT NULL" for i, (a, k) in enumerate(zip(AT_SQL, ["registry_created", "registry_modified", "first_commit"], strict=True))) + "))")
def timeline_events(spark, d):
    """A package's events by date."""
    rows = table(spark, d, "orders").select("o_orderkey", store.timeline(*[F.expr(a) for a in AT]).alias("events"))
    return rows.select("o_orderkey", F.posexplode("events").alias("place", "e")).select("o_orderkey", F.col("place").cast("long").alias("place"), "e.type", "e.at")


@query("merged_evidence", """
SELECT p_partkey, round((CASE WHEN p_size % 3 <> 0 THEN least(1.0, (p_size / 50.0 + p_partkey % 7 / 6.0) / 2) ELSE p_size / 50.0 END)::DOUBLE, 6) AS score,
  CASE WHEN p_size % 3 = 0 OR p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END AS phrases FROM part""")
def merged_evidence(spark, d):
    """Evidence of documentation and issues in one (U4)."""
    both = store.merged_evidence(F.col("p_size") / 50.0, F.array("p_brand", "p_brand"), F.when(F.col("p_size") % 3 != 0, F.col("p_partkey") % 7 / 6.0), F.array("p_type", "p_brand"))
    rows = table(spark, d, "part").select("p_partkey", both.alias("b"))
    return rows.select("p_partkey", F.round("b.score", 6).alias("score"), F.array_join(F.array_distinct("b.phrases"), "|").alias("phrases"))


@query("option_errors", f"""
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN d <> floor(d) OR d NOT BETWEEN 0 AND 10 THEN 'max_depth' END, CASE WHEN w NOT BETWEEN 1 AND 16 THEN 'workers' END, CASE WHEN o NOT IN ({', '.join(map(S.quoted, fixed.OUTPUT_FORMATS))}) THEN 'output' END], lambda x: x IS NOT NULL), ',') AS errors
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 4.0 AS d, CASE WHEN l_linenumber < 7 THEN l_partkey % 19 END AS w, CASE WHEN l_returnflag = 'N' THEN 'json' WHEN l_returnflag = 'R' THEN 'xml' END AS o FROM lineitem)""")
def option_errors(spark, d):
    """Scan options out of bounds."""
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity / 4.0 AS max_depth", "CASE WHEN l_linenumber < 7 THEN l_partkey % 19 END AS workers", "CASE WHEN l_returnflag = 'N' THEN 'json' WHEN l_returnflag = 'R' THEN 'xml' END AS output")
    return validate.option_errors(rows).select("l_orderkey", "l_linenumber", F.array_join("errors", ",").alias("errors"))


TARGET = "CASE p_size % 5 WHEN 0 THEN '../' || p_brand WHEN 1 THEN 'a/../b/./' || p_brand WHEN 2 THEN '/srv/scans/' || p_brand WHEN 3 THEN '/srv/scans/../other/' || p_brand END"


@query("targets_in_root", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '/srv/' || p_brand WHEN 1 THEN '/srv/scans/b/' || p_brand WHEN 2 THEN '/srv/scans/' || p_brand WHEN 3 THEN '/srv/other/' || p_brand ELSE '/srv/scans' END AS path, p_size % 5 IN (1, 2, 4) AS inside FROM part""")
def targets_in_root(spark, d):
    """Targets resolved, and whether they lie in the root."""
    target = F.expr(TARGET)
    return table(spark, d, "part").select("p_partkey", validate.resolved(target, "/srv/scans").alias("path"), validate.inside_root(target, "/srv/scans").alias("inside"))


PATH = "CASE p_size % 4 WHEN 0 THEN 'lib/' || p_brand || '/scan.js' WHEN 1 THEN '/app/vendor/own/' || p_brand WHEN 2 THEN 'test/' || p_brand ELSE 'src/' || p_brand END"


@query("code_confidence", f"""
WITH p AS (SELECT p_partkey, {PATH} AS path FROM part), f AS (SELECT *, ends_with(path, '/scan.js') OR contains(path, '/own/') AS o, {S.is_test_file('path')} AS t, contains(path, '#11') AS c FROM p)
SELECT p_partkey, o AS own, t AS test, (CASE WHEN o THEN 100 WHEN t THEN 90 WHEN c THEN 80 ELSE 0 END)::INTEGER AS confidence, o AND true AS strict_own FROM f""")
def code_confidence(spark, d):
    """Own, test and other code with its confidence."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(PATH).alias("path"))
    own = report.own_code(F.col("path"), ["scan.js"], ["/own/"])
    found = rows.select("p_partkey", report.code_confidence(F.col("path"), own, ["#11"]).alias("f"), report.code_confidence(F.col("path"), own, strict=True).alias("s"))
    return found.select("p_partkey", "f.own", "f.test", "f.confidence", F.col("s.own").alias("strict_own"))


DETAIL = "CASE WHEN p_size % 2 = 0 THEN 'MALICIOUS CODE DETECTED:  ' ELSE '' END || p_name || '  Confidence: ' || p_size || '% (' || p_size || ' threats)'"


@query("cleaned_details", "SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS details FROM part WHERE p_name IS NOT NULL")
def cleaned_details(spark, d):
    """Details for a report."""
    return table(spark, d, "part").where("p_name IS NOT NULL").select("p_partkey", report.cleaned_details(F.expr(DETAIL)).alias("details"))


@query("model_gates", """
WITH m AS (SELECT lang, count(*) FILTER (WHERE toxic = 1) AS positives, avg((toxic = (quality = 0)::INT)::INT) AS accuracy, avg(quality) FILTER (WHERE toxic = 1) AS precision FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, positives, array_to_string(list_filter([CASE WHEN accuracy < 0.5 THEN 'accuracy' END, CASE WHEN precision < 0.5 AND positives > 0 THEN 'precision' END], lambda x: x IS NOT NULL), ',') AS failed, CASE WHEN positives > 0 THEN '' ELSE 'precision' END AS skipped FROM m""")
def model_gates(spark, d):
    """Metrics by language against gates (M8)."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    toxic = F.col("toxic") == 1
    measured = rows.groupBy("lang").agg(F.count_if(toxic).alias("positives"), F.avg((F.col("toxic") == (F.col("quality") == 0).cast("int")).cast("int")).alias("accuracy"), F.avg(F.when(toxic, F.col("quality"))).alias("precision"))
    return learn.gates(measured, {"accuracy": 0.5, "precision": 0.5}).select("lang", "positives", F.array_join("failed", ",").alias("failed"), F.array_join("skipped", ",").alias("skipped"))


@query("model_reasons", """
SELECT c_custkey, format('timeline={:.2f}: young', (c_custkey % 5) / 5.0) AS first, format('nlp={:.2f}', (c_custkey % 4) / 4.0) AS second, 2::INTEGER AS reasons FROM customer""")
def model_reasons(spark, d):
    """Importance in words."""
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 5 / 5.0).alias("timeline"), (F.col("c_custkey") % 4 / 4.0).alias("nlp"), F.lit(1.0).alias("trust"))
    found = rows.select("c_custkey", learn.reasons({"nlp": 0.2, "timeline": 0.7, "trust": 0.0}, {"timeline": "young"}).alias("r"))
    return found.select("c_custkey", F.col("r")[0].alias("first"), F.col("r")[1].alias("second"), F.size("r").alias("reasons"))


@query("other_schemas", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size % 4 END AS version FROM part WHERE p_size % 3 <> 0 AND p_size % 4 <> 2")
def other_schemas(spark, d):
    """Models of another feature schema."""
    rows = table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_size % 3 <> 0 THEN p_size % 4 END AS version")
    return learn.other_schemas(rows, "version", 2)
