"""Queries of packages' documents, issues, downloads and stars, from JSON that the generated tables are turned into."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..registry import query, table
from ..session import shared_folder
from ..sources import community as C
from . import sqltext as S

PARTS = """(SELECT p_partkey AS k, 'pkg-' || p_partkey AS package, p_name AS readme, p_type AS told, p_partkey % 40 AS r, p_size, p_partkey % 7 <> 0 AS counted, p_partkey % 11 <> 0 AS listed FROM part)"""
OWNER = "CASE WHEN k % 5 = 4 THEN NULL ELSE 'owner' || r || '/repo' || r END"
WORDS, PHRASES, MOODS = ["the", "of", "and", "idiot", "rights"], [r"all\s+rights\s+reserved", r"of\s+the", r"and\s+the\s+of"], ["idiot", "clown", "scum"]


def landed(spark, rows):
    """Lines of JSON written to the shared folder and read again."""
    path = f"{shared_folder(spark)}/community-{uuid.uuid4().hex}"
    rows.select("value").write.text(path)
    return spark.read.text(path)


def documents_of(spark, d):
    """Parts as packages' documents: versions by tag, by name or the last one; repositories as text and as objects."""
    table(spark, d, "part").createOrReplaceTempView("ferrule_part")
    rows = spark.sql("SELECT * FROM " + PARTS.replace("FROM part", "FROM ferrule_part"))
    at = F.concat(F.lit("github.com/owner"), F.col("r").cast("string"), F.lit("/repo"), F.col("r").cast("string"))
    plain = F.to_json(F.struct(F.concat(F.lit("git+https://"), at, F.lit(".git")).alias("url")))
    place = F.when(F.col("k") % 5 == 4, None).when(F.col("k") % 5 < 2, F.concat(F.lit(',"repository":'), plain)).otherwise(F.concat(F.lit(',"repository":"https://'), at, F.lit('"')))
    tagged, other = F.concat(F.lit('{"description":"'), "told", F.lit('"'), F.coalesce(place, F.lit("")), F.lit("}")), F.lit('{"description":"other","repository":"x"}')
    versions = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"1.0.0":'), tagged, F.lit(',"9.0.0":'), other, F.lit('},"dist-tags":{"latest":"1.0.0"}'))).when(F.col("k") % 3 == 1, F.concat(F.lit('{"0.1.0":'), other, F.lit(',"latest":'), tagged, F.lit(',"2.0.0":'), other, F.lit("}")))
    versions = F.coalesce(versions, F.concat(F.lit('{"0.1.0":'), other, F.lit(',"0.2.0":'), tagged, F.lit("}")))
    value = F.concat(F.lit('{"name":"'), "package", F.lit('","readme":"'), "readme", F.lit('","versions":'), versions, F.lit("}"))
    return rows, C.package_docs(landed(spark, rows.withColumn("value", value)))


@query("package_docs", f"SELECT package, readme, told AS description, CASE WHEN k % 5 = 4 THEN NULL ELSE 'https://github.com/' || {OWNER} END AS repository_url FROM {PARTS}")
def package_docs(spark, d):
    """Read-me, description and repository of packages."""
    return documents_of(spark, d)[1]


@query("community_scores", f"""
SELECT package, {OWNER} AS repository, CASE WHEN counted THEN p_size * 1000 ELSE 0 END::BIGINT AS downloads, CASE WHEN r % 4 <> 0 AND k % 5 <> 4 THEN r * 300 END::BIGINT AS stars,
  round(least(1.0, 0.5 * least(1.0, CASE WHEN counted THEN log10(p_size * 1000 + 1) ELSE 0.0 END / 6) + 0.3 * CASE WHEN r % 4 <> 0 AND k % 5 <> 4 THEN least(1.0, r * 300 / 10000) ELSE 0.5 END + 0.1)::DOUBLE, 6) AS popularity FROM {PARTS}""")
def community_scores(spark, d):
    """Popularity from landed downloads and stars."""
    rows, docs = documents_of(spark, d)
    downloads = rows.where("listed OR counted").withColumn("value", F.to_json(F.struct("package", F.when(F.col("counted"), (F.col("p_size") * 1000).cast("string")).otherwise("none").cast("string").alias("downloads"))))
    number = F.col("r").cast("string")
    stars = rows.where("r % 4 <> 0").select("r").distinct().withColumn("value", F.to_json(F.struct(F.concat(F.lit("owner"), number, F.lit("/repo"), number).alias("full_name"), (F.col("r") * 300).alias("stargazers_count"))))
    found = C.community(docs, C.number_of(landed(spark, downloads), "package", "downloads"), C.number_of(landed(spark, stars), "full_name", "stargazers_count"))
    return found.withColumn("popularity", F.round("popularity", 6))


ISSUES = "(SELECT 'owner' || conv_id || '/repo' || conv_id AS repository, turn, role AS title, text AS body, turn % 3 = 0 AS marked FROM conversations)"


def issues_of(spark, d):
    rows = table(spark, d, "conversations").withColumn("number", F.col("conv_id").cast("string"))
    labels = F.when(F.col("turn") % 3 == 0, F.array(F.struct(F.lit("Security bug").alias("name")), F.struct(F.lit("x").alias("name"))))
    one = F.struct("turn", F.col("role").alias("title"), F.col("text").alias("body"), labels.alias("labels"))
    lists = rows.groupBy(F.concat(F.lit("owner"), "number", F.lit("/repo"), "number").alias("repository")).agg(F.array_sort(F.collect_list(one)).alias("issues"))
    return C.issues(landed(spark, lists.withColumn("value", F.to_json(F.struct("repository", "issues")))), most=4)


SAID = f"(SELECT *, concat_ws(' ', title, body) AS t, row_number() OVER (PARTITION BY repository ORDER BY turn) AS rn FROM {ISSUES})"
KEYWORDS = " + ".join(f"len(regexp_extract_all(t, '(?i){chr(92)}b{w}{chr(92)}b'))" for w in WORDS)
FOUND = f"list_filter([{', '.join(f'trim(regexp_extract(t, {S.quoted("(?i)" + p)}))' for p in PHRASES)}], lambda x: x <> '')"


@query("issue_evidence", f"""
WITH s AS (SELECT repository, marked, list_distinct({FOUND}) AS p, {KEYWORDS} AS n FROM {SAID} WHERE rn <= 4)
SELECT repository, count(*)::BIGINT AS issues, count(*) FILTER (marked)::BIGINT AS security_labels, max(round(least(1.0, (least(1.0, n * 0.1) + least(1.0, len(p) * 0.2)) / 2)::DOUBLE, 6)) AS nlp_score, list_sort(list_distinct(flatten(list(p)))) AS phrases FROM s GROUP BY repository""")
def issue_evidence(spark, d):
    """Labels and language of repositories' latest issues."""
    return C.issue_evidence(issues_of(spark, d), WORDS, PHRASES, MOODS)
