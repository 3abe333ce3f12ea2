"""Queries of small expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import misc
from ..registry import query, table
from .standins import THREATS_SQL, threats

ADDRESS = "CASE p_size % 4 WHEN 0 THEN 'git+https://github.com/o' || p_size || '/' || replace(p_name, ' ', '-') || '.git' WHEN 1 THEN 'git@github.com:x/' || p_size WHEN 2 THEN 'https://other.org/' || p_name ELSE 'https://github.com/a/b#readme' END"


@query("code_threats", "SELECT scan_id, ord, type IN (" + ", ".join(f"'{x}'" for x in misc.CODE_THREATS) + ") OR " + " OR ".join(f"starts_with(type, '{p}')" for p in misc.CODE_PREFIXES) + f" AS in_code FROM {THREATS_SQL}")
def code_threats(spark, d):
    return threats(spark, d).select("scan_id", "ord", misc.is_code_threat(F.col("type")).alias("in_code"))


@query("role_rights", "SELECT c_custkey, role IN ('admin', 'analyst') AS may_scan, role = 'admin' AS may_webhooks FROM (SELECT c_custkey, ['admin', 'analyst', 'viewer', 'other'][1 + c_nationkey % 4] AS role FROM customer)")
def role_rights(spark, d):
    role = F.element_at(F.array(*[F.lit(x) for x in ("admin", "analyst", "viewer", "other")]), F.col("c_nationkey") % 4 + 1)
    return table(spark, d, "customer").select("c_custkey", misc.may(role, "scan").alias("may_scan"), misc.may(role, "webhooks").alias("may_webhooks"))


@query("repositories", f"SELECT p_partkey, nullif(regexp_extract(regexp_replace(regexp_replace(a, '^git\\+', ''), '\\.git$', ''), 'github\\.com[/:]([^/]+/[^/#?]+)', 1), '') AS repository, CASE WHEN length(a) > 30 THEN substr(a, 1, 27) || '...' ELSE a END AS short FROM (SELECT p_partkey, {ADDRESS} AS a FROM part)")
def repositories(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.expr(ADDRESS).alias("a"))
    return a.select("p_partkey", misc.repository(F.col("a")).alias("repository"), misc.shortened(F.col("a"), 30).alias("short"))


@query("reference_lists", "SELECT p_partkey, list_filter(list_transform(string_split_regex(p_name || ', ' || p_brand || chr(10) || ',' || p_type, '[,\\n]'), lambda x: trim(x)), lambda x: x <> '') AS items, '1998-01-01T00-00-00-000Z_' || substr(regexp_replace(p_name || '/' || p_brand, '/', '_', 'g'), 1, 50) || '.json' AS file_name FROM part")
def reference_lists(spark, d):
    text = F.concat("p_name", F.lit(", "), "p_brand", F.lit("\n,"), "p_type")
    return table(spark, d, "part").select("p_partkey", misc.references(text).alias("items"), misc.file_name(F.concat("p_name", F.lit("/"), "p_brand"), F.lit("1998-01-01T00:00:00.000Z")).alias("file_name"))


@query("backoff_delays", "SELECT p_partkey, least(30.0, pow(2.0, p_size % 8))::DOUBLE AS delay, least(30.0, pow(4.0, p_size % 8))::DOUBLE AS limited_delay FROM part")
def backoff_delays(spark, d):
    n = F.col("p_size") % 8
    return table(spark, d, "part").select("p_partkey", misc.delay(n).alias("delay"), misc.delay(n, limited=True).alias("limited_delay"))


@query("advisory_mentions", "SELECT p_partkey, list_contains(string_split_regex(lower(p_name || ' in ' || p_brand), '[^a-z0-9@/_-]+'), lower(p_type)) OR (list_contains(string_split_regex(lower(p_name || ' in ' || p_brand), '[^a-z0-9@/_-]+'), lower(string_split(p_name, ' ')[1])) AND lower(string_split(p_name, ' ')[1]) NOT IN ('red', 'blue')) AS about FROM part")
def advisory_mentions(spark, d):
    text = F.concat_ws(" ", "p_name", F.lit("in"), "p_brand")
    about = misc.mentions_product(text, F.col("p_type"), []) | misc.mentions_product(text, F.split("p_name", " ")[0], ["red", "blue"])
    return table(spark, d, "part").select("p_partkey", about.alias("about"))


@query("scan_rates", "SELECT o_orderkey, CASE WHEN ms > 0 THEN floor(o_totalprice * 1000 / ms * 100 + 0.5) / 100 ELSE 0.0 END AS per_second FROM (SELECT o_orderkey, o_totalprice, (o_custkey % 50)::DOUBLE AS ms FROM orders)")
def scan_rates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", misc.rate(F.col("o_totalprice"), (F.col("o_custkey") % 50).cast("double")).alias("per_second"))
