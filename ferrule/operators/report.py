"""Report rows and documents as columns: SARIF, CSV lines, diagnostics, content identifiers, code types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import contains_any
from .detect import is_config_file, is_test_file

BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "MEDIUM", "warning").otherwise("note")


def sarif(threats: DataFrame, key: str, tool: str = "ferrule") -> DataFrame:
    """One SARIF 2.1.0 document per key (S27), built from nested structs."""
    result = F.struct(F.col("type").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.concat_ws(" in ", "type", F.col("package").cast("string")).alias("text")).alias("message"))
    grouped = threats.groupBy(key).agg(F.collect_list(result).alias("results"), F.array_sort(F.collect_set("type")).alias("types"))
    rules = F.transform("types", lambda t: F.struct(t.alias("id")))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.col("results"))
    return grouped.select(key, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def csv_line(columns: list[str]) -> Column:
    """All fields quoted, quotes doubled."""
    field = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[field(c) for c in columns])


def diagnostics(rows: DataFrame, path: str, message: str) -> DataFrame:
    """Sorted messages per file."""
    return rows.groupBy(path).agg(F.array_sort(F.collect_list(message)).alias("messages"))


def code_type(files: DataFrame, path: str) -> DataFrame:
    """Test, config, source or other."""
    p = F.col(path)
    return files.select(path, F.when(is_test_file(p), "test").when(is_config_file(p), "config").when(p.rlike(r"\.(js|ts|jsx|tsx)$"), "source").otherwise("other").alias("code_type"))


def code_confidence(path: Column, own: Column, custom: list[str] | None = None, strict: bool = False) -> Column:
    """(own, test, confidence) of a path (P5): own code 100, a test 90, a custom part of a path 80, else 0.

    Strictly, anything under 95 counts as neither.  ``own`` is the caller's predicate, such as ``own_code``.
    """
    mine, test = F.coalesce(own, F.lit(False)), F.coalesce(is_test_file(path), F.lit(False))
    marked = F.coalesce(contains_any(path, custom), F.lit(False)) if custom else F.lit(False)
    sure = F.when(mine, 100).when(test, 90).when(marked, 80).otherwise(0)
    keep = (sure >= 95) if strict else F.lit(True)
    return F.struct((mine & keep).alias("own"), (test & keep).alias("test"), F.when(keep, sure).otherwise(0).alias("confidence"))


def own_code(path: Column, names: list[str], marks: list[str]) -> Column:
    """Whether a path is the project's own (P2): a file of these names, or with one of these parts; null is not."""
    found = F.regexp_extract(path, r"[^/]*$", 0).isin(names) if names else F.lit(False)
    return F.coalesce(found | contains_any(path, marks) if marks else found, F.lit(False))


def cleaned_details(details: Column) -> Column:
    """Details without prefix, confidence and count, on one line."""
    for pattern in fixed.DETAIL_PATTERNS:
        details = F.regexp_replace(details, pattern, "")
    return F.trim(F.regexp_replace(details, r"\s+", " "))


def content_id(text: Column) -> Column:
    """Version 1 content identifier of raw bytes (F26): 0x01 0x55 0x12 0x20 and the SHA-256, in base 32, five bits a sign.

    Ten hex digits at a time become eight signs by one change of base, so a row costs eight of these and no Python runs.
    """
    digits = F.concat(F.lit("01551220"), F.sha2(text, 256))
    signs = [F.lpad(F.conv(F.substr(digits, F.lit(1 + 10 * i), F.lit(10)), 16, 32), 8, "0") for i in range(7)]
    # 36 bytes are 288 bits; of the last byte two more bits make two signs.
    last = F.lpad(F.conv((F.conv(F.substr(digits, F.lit(71), F.lit(2)), 16, 10).cast("int") * 4).cast("string"), 10, 32), 2, "0")
    return F.concat(F.lit("b"), F.translate(F.concat(*signs, last), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32))
