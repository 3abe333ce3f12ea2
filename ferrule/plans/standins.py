"""The generated tables in the roles of a scanner's: files, threats, scans, packages, commits, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table
from ..session import spread
from .sqltext import SEVERITY, THREAT_TYPE

#: A rule set for natural text, so that rules also meet matches in documents.
TEXT_RULES = {
    "insults": ("HIGH", "Insulting words", 0.6, ["idiot", "moron", "worthless", "pathetic"]),
    "shouting": ("LOW", "Capitals and marks", 0.5, [r"[a-z]+!!", r"all rights reserved"]),
    "contact": ("MEDIUM", "Addresses and numbers", 0.7, [r"[a-z0-9._]+@[a-z0-9.]+", r"\+[0-9]+ \([0-9]+\)", r"[0-9]{16}"]),
}


def document_files(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("content"))


def page_files(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages")).select(F.col("page_id").alias("file_id"), F.coalesce("html", F.lit("")).alias("content"))


def threats(spark: SparkSession, d: str) -> DataFrame:
    """Line items as threats: order = scan, part = package, discount = doubt."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").cast("long").alias("ord"), F.col("l_partkey").alias("package"),
        F.expr(THREAT_TYPE).alias("type"), F.expr(SEVERITY).alias("severity"), (1 - F.col("l_discount").cast("double")).alias("confidence"),
    )


THREATS_SQL = (
    f"(SELECT l_orderkey AS scan_id, l_linenumber::BIGINT AS ord, l_partkey AS package, {THREAT_TYPE} AS type, {SEVERITY} AS severity, "
    "1 - l_discount::DOUBLE AS confidence FROM lineitem)"
)
