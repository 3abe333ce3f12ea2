"""Queries of graphs, paths, code types and report formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, report
from ..registry import query, table
from . import sqltext as S
from .standins import THREATS_SQL, threats

TREE_NODES = "(SELECT 'r' || r_regionkey AS node, (r_regionkey % 5) / 8.0::DOUBLE AS base FROM region UNION ALL SELECT 'n' || n_nationkey, (n_nationkey % 4) / 16.0::DOUBLE FROM nation UNION ALL SELECT 's' || s_suppkey, (s_suppkey % 32) / 32.0::DOUBLE FROM supplier)"
TREE_EDGES = "(SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


def tree(spark, d):
    """Regions, nations and suppliers as a dependency tree."""
    region, nation, supplier = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = (
        region.select(name("r", "r_regionkey").alias("node"), ((F.col("r_regionkey") % 5) / 8.0).alias("base"))
        .unionByName(nation.select(name("n", "n_nationkey").alias("node"), ((F.col("n_nationkey") % 4) / 16.0).alias("base")))
        .unionByName(supplier.select(name("s", "s_suppkey").alias("node"), ((F.col("s_suppkey") % 32) / 32.0).alias("base")))
    )
    edges = nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionByName(
        supplier.select(name("n", "s_nationkey").alias("parent"), name("s", "s_suppkey").alias("child")))
    return nodes, edges


PROPAGATED = f"""
WITH RECURSIVE t AS (
  SELECT node, base, base AS risk FROM {TREE_NODES} WHERE node NOT IN (SELECT child FROM {TREE_EDGES})
  UNION ALL SELECT n.node, n.base, least(1.0, greatest(n.base, 0.85 * t.risk))::DOUBLE FROM t JOIN {TREE_EDGES} e ON e.parent = t.node JOIN {TREE_NODES} n ON n.node = e.child)
SELECT node, round(base, 6) AS base, round(max(risk), 6)::DOUBLE AS risk FROM t GROUP BY node, base"""


@query("risk_propagation", PROPAGATED)
def risk_propagation(spark, d):
    found = graph.propagate_risk(*tree(spark, d))
    return found.select("node", F.round("base", 6).alias("base"), F.round("risk", 6).alias("risk"))


@query("highest_risk", f"SELECT max(risk) AS risk FROM ({PROPAGATED})")
def highest_risk(spark, d):
    """The highest propagated risk of the whole graph."""
    return graph.highest_risk(risk_propagation(spark, d))


@query("root_risks", f"SELECT node, base, risk FROM ({PROPAGATED}) WHERE node LIKE 'r%'")
def root_risks(spark, d):
    """Risks of the roots alone."""
    nodes, edges = tree(spark, d)
    found = graph.root_risks(graph.propagate_risk(nodes, edges), edges)
    return found.select("node", F.round("base", 6).alias("base"), F.round("risk", 6).alias("risk"))


@query("impacted_nodes", f"SELECT node, risk FROM ({PROPAGATED}) WHERE risk >= 0.3")
def impacted_nodes(spark, d):
    return graph.impacted(risk_propagation(spark, d)).select("node", "risk")


@query("transitive_trust", f"""
WITH s AS (SELECT 's' || s_suppkey AS node, 'n' || s_nationkey AS parent, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE (s_suppkey % 8) / 8.0::DOUBLE END AS t FROM supplier),
n AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent, coalesce(CASE WHEN n_nationkey % 6 = 0 THEN 0.5 END, least(1.0, coalesce(0.3 * (SELECT avg(t) FROM s WHERE s.parent = 'n' || n_nationkey), 0.0)), 0.0)::DOUBLE AS t, n_nationkey % 6 = 0 AS direct FROM nation),
r AS (SELECT 'r' || r_regionkey AS node, least(1.0, coalesce(0.3 * (SELECT avg(t) FROM n WHERE n.parent = 'r' || r_regionkey AND (direct OR t > 0)), 0.0))::DOUBLE AS t FROM region)
SELECT node, round(coalesce(t, 0.0), 6)::DOUBLE AS trust FROM (SELECT node, t FROM s UNION ALL SELECT node, t FROM n UNION ALL SELECT node, t FROM r)""")
def transitive_trust(spark, d):
    nodes, edges = tree(spark, d)
    number = F.substring("node", 2, 20).cast("int")
    direct = F.when(F.col("node").startswith("s") & (number % 3 != 0), (number % 8) / 8.0).when(F.col("node").startswith("n") & (number % 6 == 0), 0.5)
    return graph.transitive_trust(nodes.select("node", direct.alias("direct")), edges).select("node", F.round("trust", 6).alias("trust"))


@query("sarif_results", f"""
SELECT scan_id, count(*)::BIGINT AS results, count(DISTINCT type)::BIGINT AS rules, count(CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 1 END)::BIGINT AS errors FROM {THREATS_SQL} GROUP BY scan_id""")
def sarif_results(spark, d):
    """Counts read back out of one SARIF document per scan."""
    docs = report.sarif(threats(spark, d), "scan_id")
    run = "array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<struct<ruleId:string,level:string>>>>"
    runs = docs.select("scan_id", F.from_json("sarif", f"struct<runs:{run}>")["runs"][0].alias("r"))
    return runs.select("scan_id", F.size("r.results").cast("long").alias("results"), F.size("r.tool.driver.rules").cast("long").alias("rules"), F.size(F.filter("r.results", lambda x: x["level"] == "error")).cast("long").alias("errors"))


@query("csv_rows", f"""
SELECT '"' || scan_id || '","' || ord || '","' || type || '","' || severity || '"' AS line FROM {THREATS_SQL}""")
def csv_rows(spark, d):
    return threats(spark, d).select(report.csv_line(["scan_id", "ord", "type", "severity"]).alias("line"))


@query("diagnostics", f"SELECT package AS file_path, list_sort(list(severity || ' ' || type || ' @' || scan_id || ':' || ord)) AS messages FROM {THREATS_SQL} GROUP BY package")
def diagnostics(spark, d):
    """Messages grouped per file."""
    text = F.concat("severity", F.lit(" "), "type", F.lit(" @"), F.col("scan_id").cast("string"), F.lit(":"), F.col("ord").cast("string"))
    return report.diagnostics(threats(spark, d).withColumn("text", text), "package", "text").withColumnRenamed("package", "file_path")


@query("code_types", f"""
SELECT file_path, CASE WHEN {S.is_test_file('file_path')} THEN 'test' WHEN ends_with(file_path, '.config.js') THEN 'config' WHEN regexp_matches(file_path, '\\.(js|ts|jsx|tsx)$') THEN 'source' ELSE 'other' END AS code_type
FROM (SELECT p_name || '/' || p_brand || CASE WHEN p_size % 3 = 0 THEN '.test.js' WHEN p_size % 5 = 0 THEN '.config.js' WHEN p_size % 7 = 0 THEN '.md' ELSE '.js' END AS file_path FROM part)""")
def code_types(spark, d):
    """Paths classified by name."""
    path = F.expr("p_name || '/' || p_brand || CASE WHEN p_size % 3 = 0 THEN '.test.js' WHEN p_size % 5 = 0 THEN '.config.js' WHEN p_size % 7 = 0 THEN '.md' ELSE '.js' END")
    return report.code_type(table(spark, d, "part").select(path.alias("file_path")), "file_path")


def bits_sql(digits: str) -> str:
    """The bits of hex digits, four a digit."""
    return f"list_aggregate(list_transform(string_split({digits}, ''), lambda x: lpad(bin(instr('0123456789abcdef', x) - 1), 4, '0')), 'string_agg', '')"


@query("content_ids", f"""
SELECT doc_id, 'b' || list_aggregate(list_transform(range(0, 58), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', 1 + list_aggregate(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, i * 5 + j + 1, 1) = '1' THEN 16 // (2 ** j)::INT ELSE 0 END), 'sum')::INT, 1)), 'string_agg', '') AS cid
FROM (SELECT doc_id, {bits_sql("('01551220' || sha256(coalesce(text, '')))")} || '00' AS bits FROM documents)""")
def content_ids(spark, d):
    """Content identifiers in base 32."""
    return table(spark, d, "documents").select("doc_id", report.content_id(F.coalesce("text", F.lit(""))).alias("cid"))


def insult_plugin(content: str, file_id: int) -> list[dict]:
    return [{"type": "PLUGIN_INSULT", "severity": "LOW", "confidence": 0.4}] if "idiot" in content else []


@query("plugin_udtf", "SELECT doc_id AS file_id, 'PLUGIN_INSULT' AS type, 'LOW' AS severity, 0.4::DOUBLE AS confidence FROM documents WHERE contains(text, 'idiot')")
def plugin_udtf(spark, d):
    """A plugin's threats."""
    from ..operators.plugins import run_plugin
    from .standins import document_files

    return run_plugin(document_files(spark, d), insult_plugin)
