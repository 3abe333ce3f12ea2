"""Landed JSON about packages' documents, issues, downloads and stars, a response a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.misc import repository
from ..operators import enrich
from ..operators.store import merged_evidence

#: A package's document; a repository is an address or an object that has one, so it stays text.
DOCUMENT = "name string, readme string, repository string, `dist-tags` map<string,string>, versions map<string,struct<description:string,repository:string>>"
ISSUES = "repository string, issues array<struct<title:string,body:string,state:string,labels:array<struct<name:string>>>>"
#: Issues of a repository that are looked at, the latest first.
MOST_ISSUES = 30


def parsed(lines: DataFrame, schema: str, value: str) -> DataFrame:
    """The lines that are JSON objects, by field; others give no row."""
    return lines.select(F.from_json(value, schema).alias("r")).where("r IS NOT NULL").select("r.*")


def address(text: Column) -> Column:
    """A repository's address: of an object its url, without git+ and .git; plain text as it is."""
    plain = F.regexp_replace(F.regexp_replace(F.get_json_object(text, "$.url"), r"^git\+", ""), r"\.git$", "")
    return F.when(text.startswith("{"), plain).otherwise(F.nullif(text, F.lit("")))


def package_docs(lines: DataFrame, version: str = "latest", value: str = "value") -> DataFrame:
    """(package, readme, description, repository_url) of packages' documents.

    The version asked for counts, for ``latest`` also the one tagged so, else the last one listed; packages without
    any have no row.
    """
    rows = parsed(lines, DOCUMENT, value)
    tagged = F.try_element_at("versions", F.try_element_at("`dist-tags`", F.lit("latest"))) if version == "latest" else F.lit(None)
    own = F.coalesce(F.try_element_at("versions", F.lit(version)), tagged, F.try_element_at("versions", F.element_at(F.map_keys("versions"), -1)))
    found = rows.where("name IS NOT NULL AND size(versions) > 0").withColumn("own_", own).where("own_ IS NOT NULL")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return found.select(
        F.col("name").alias("package"), empty(F.col("readme")).alias("readme"), empty(F.col("own_.description")).alias("description"),
        address(F.coalesce(F.nullif(F.col("own_.repository"), F.lit("")), "repository")).alias("repository_url"),
    )


def issues(lines: DataFrame, most: int = MOST_ISSUES, value: str = "value") -> DataFrame:
    """(repository, place, title, body, state, labels) of the first ``most`` issues of each response (S16); the limit is the feature."""
    rows = parsed(lines, ISSUES, value).where("repository IS NOT NULL").select("repository", F.posexplode(F.slice("issues", 1, most)).alias("place", "i"))
    labels = F.transform(F.coalesce("i.labels", F.array()), lambda one: F.coalesce(one["name"], F.lit("")))
    return rows.select("repository", "place", F.coalesce("i.title", F.lit("")).alias("title"), "i.body", F.coalesce(F.nullif("i.state", F.lit("")), F.lit("open")).alias("state"), labels.alias("labels"))


def number_of(lines: DataFrame, key: str, field: str, value: str = "value") -> DataFrame:
    """(key, number) of responses with a whole number in ``field``, null where it is none."""
    kept = F.get_json_object(value, f"$.{key}")
    return lines.select(kept.alias("key"), F.get_json_object(value, f"$.{field}").try_cast("long").alias("number")).where("key IS NOT NULL")


def community(docs: DataFrame, downloads: DataFrame, stars: DataFrame) -> DataFrame:
    """(package, repository, downloads, stars, popularity) from documents, weekly downloads by package and stars by repository.

    Downloads that aren't known are 0, stars unknown; nobody says how many packages depend on one.
    """
    named = docs.select("package", repository(F.col("repository_url")).alias("repository"))
    joined = named.join(downloads.select(F.col("key").alias("p_"), F.col("number").alias("downloads")), F.col("package") == F.col("p_"), "left")
    joined = joined.join(stars.select(F.col("key").alias("r_"), F.col("number").alias("stars")), F.col("repository") == F.col("r_"), "left")
    known = F.coalesce("downloads", F.lit(0)).cast("long")
    return joined.select("package", "repository", known.alias("downloads"), "stars", enrich.popularity(known, F.col("stars"), F.lit(None).cast("long")).alias("popularity"))


def issue_evidence(found: DataFrame, keywords: list[str] | None = None, phrases: list[str] | None = None, negative: list[str] | None = None, marks: str = "security|vulnerab") -> DataFrame:
    """(repository, issues, security_labels, nlp_score, phrases) of repositories' issues.

    Issues are scored each and then taken together: the highest score, and all phrases in order.
    """
    scored = enrich.nlp_scores(found.withColumn("said_", F.concat_ws(" ", "title", "body")), "said_", keywords, phrases, negative)
    marked = F.exists("labels", lambda one: F.lower(one).rlike(marks))
    return scored.groupBy("repository").agg(
        F.count("*").alias("issues"), F.count_if(marked).alias("security_labels"), F.max("nlp_score").alias("nlp_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("phrases")))).alias("phrases")
    )


def package_evidence(docs: DataFrame, evidence: DataFrame, keywords: list[str] | None = None, phrases: list[str] | None = None, negative: list[str] | None = None) -> DataFrame:
    """(package, score, phrases): documents' evidence merged with that of their repository's issues, if there is any (U4)."""
    own = enrich.nlp_scores(docs.withColumn("said_", F.concat_ws(" ", "readme", "description")), "said_", keywords, phrases, negative)
    own = own.select("package", repository(F.col("repository_url")).alias("at_"), F.col("nlp_score").alias("own_score"), F.col("phrases").alias("own_phrases"))
    joined = own.join(evidence.select(F.col("repository").alias("r_"), "nlp_score", "phrases"), F.col("at_") == F.col("r_"), "left")
    merged = merged_evidence(F.col("own_score"), F.col("own_phrases"), F.col("nlp_score"), F.col("phrases"))
    return joined.select("package", merged.alias("m_")).select("package", "m_.*")
