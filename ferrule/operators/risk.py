"""Composite risk of threats (A1), and what reports derive from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import round2

LEVELS = list(fixed.SEVERITY_SCORES)


def severity_score(severity: Column) -> Column:
    """1 to 0.25; 0.5 for anything unknown."""
    out = F
    for level, score in fixed.SEVERITY_SCORES.items():
        out = out.when(severity == level, score)
    return out.otherwise(0.5)


def severity_rank(severity: Column) -> Column:
    """1 for LOW to 4 for CRITICAL, 0 for anything else."""
    out = F
    for rank, level in enumerate(reversed(LEVELS), 1):
        out = out.when(severity == level, rank)
    return out.otherwise(0)


def category(kind: Column) -> Column:
    """Confidentiality, availability, else integrity (J12); the lists are short, so no join is needed."""
    return F.when(kind.isin(fixed.CONFIDENTIALITY_THREATS), "confidentiality").when(kind.isin(fixed.AVAILABILITY_THREATS), "availability").otherwise("integrity")


def composite_risk(threats: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: sums by severity, sums by category capped at 1, and the overall risk.

    One pass of conditional sums, combined before the shuffle.
    """
    c = F.coalesce("confidence", F.lit(1.0)) * severity_score(F.col("severity"))
    named = threats.select(*keys, F.upper("severity").alias("s_"), category(F.col("type")).alias("k_"), c.alias("c_"))
    sums = named.groupBy(*keys).agg(
        F.count("*").alias("threats"),
        *[F.round(F.sum(F.when(F.col("s_") == s, F.col("c_")).otherwise(0.0)), 6).alias(s.lower()) for s in LEVELS],
        *[F.round(F.least(F.lit(1.0), F.sum(F.when(F.col("k_") == k, F.col("c_")).otherwise(0.0))), 6).alias(k) for k in fixed.CATEGORY_WEIGHTS],
    )
    weighted = sum((F.col(k) * w for k, w in fixed.CATEGORY_WEIGHTS.items()), F.lit(0.0))
    return sums.withColumn("overall", round2(F.least(F.lit(1.0), F.round(2 * weighted, 6))))


def controls(kind: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The compliance control of a threat type (J13): the first whose words the type contains."""
    out = F.lit(table[-1][0])
    for control, words in reversed(table[:-1]):
        hit = F.lit(False)
        for w in words:
            hit = hit | kind.contains(w)
        out = F.when(hit, control).otherwise(out)
    return out


SCORE_SQL = "coalesce(confidence, 1.0) * CASE upper(severity) " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in fixed.SEVERITY_SCORES.items()) + " ELSE 0.5 END"
CATEGORY_SQL = (
    "CASE WHEN type IN (" + ", ".join(f"'{x}'" for x in fixed.CONFIDENTIALITY_THREATS) + ") THEN 'confidentiality' WHEN type IN ("
    + ", ".join(f"'{x}'" for x in fixed.AVAILABILITY_THREATS) + ") THEN 'availability' ELSE 'integrity' END"
)
RISK_SQL = (
    "count(*)::BIGINT AS threats, " + ", ".join(f"round(sum(CASE WHEN upper(severity) = '{s}' THEN c ELSE 0.0 END)::DOUBLE, 6) AS {s.lower()}" for s in LEVELS) + ", "
    + ", ".join(f"round(least(1.0, sum(CASE WHEN category = '{k}' THEN c ELSE 0.0 END)::DOUBLE), 6) AS {k}" for k in fixed.CATEGORY_WEIGHTS)
    + ", floor(least(1.0, round(2 * (" + " + ".join(f"round(least(1.0, sum(CASE WHEN category = '{k}' THEN c ELSE 0.0 END)::DOUBLE), 6) * {w}" for k, w in fixed.CATEGORY_WEIGHTS.items()) + "), 6)) * 100 + 0.5) / 100 AS overall"
)
