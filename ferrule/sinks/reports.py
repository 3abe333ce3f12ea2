"""Sinks: JSON, CSV, HTML and Markdown reports, signed messages."""

from __future__ import annotations

import hashlib
import hmac
import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import sarif


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Every field quoted."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_sarif(threats: DataFrame, key: str, path: str) -> None:
    """A SARIF document a line and key."""
    sarif(threats, key).select(F.col("sarif").alias("value")).write.mode("overwrite").text(path)


def append_training(rows: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """Appends rows (features, label) that are not known yet (S32, J19), and returns them."""
    signed = lambda df: df.withColumn("key_", F.concat_ws("|", F.to_json("features"), F.col("label").cast("string")))
    fresh = signed(rows).dropDuplicates(["key_"]).join(signed(known).select("key_"), "key_", "left_anti").drop("key_")
    fresh.write.mode("append").json(path)
    return fresh


def rows_of(threats: DataFrame, most: int) -> list:
    return threats.orderBy(F.desc("confidence"), "type").limit(most).collect()


def html_report(threats: DataFrame, title: str, most: int = 1000) -> str:
    """A page with the gravest threats (S25), at most ``most`` of them."""
    counts = " ".join(f"<li>{html.escape(r['severity'])}: {r['n']}</li>" for r in threats.groupBy("severity").agg(F.count("*").alias("n")).orderBy("severity").collect())
    body = "".join(f"<tr><td>{html.escape(str(r['severity']))}</td><td>{html.escape(str(r['type']))}</td><td>{html.escape(str(r['package']))}</td></tr>" for r in rows_of(threats, most))
    left = max(0, threats.count() - most)
    body += f"<tr><td colspan=3>and {left} more</td></tr>" if left else ""
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>{counts}</ul><table>{body}</table>"


def markdown_report(threats: DataFrame, title: str, most: int = 1000) -> str:
    """The same as Markdown."""
    cell = lambda x: str(x).replace("\n", " ").replace("|", "\\|")
    lines = [f"# {cell(title)}", "", "| Severity | Type | Package |", "|-|-|-|"]
    lines += [f"| {cell(r['severity'])} | {cell(r['type'])} | {cell(r['package'])} |" for r in rows_of(threats, most)]
    left = max(0, threats.count() - most)
    return "\n".join(lines + ([f"| and {left} more | | |"] if left else []))


def signature(payload: bytes, secret: bytes) -> str:
    """HMAC-SHA-256 of a message."""
    return "sha256=" + hmac.new(secret, payload, hashlib.sha256).hexdigest()
