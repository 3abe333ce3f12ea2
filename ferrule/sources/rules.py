"""Detection rules from JSON or YAML text, checked and overlaid."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

Rules = dict[str, tuple[str, str, float, list[str]]]
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def parse(text: str) -> Rules:
    """Rules from JSON, else YAML (S20, X1); missing severity, description and threshold are MEDIUM, empty and 0.5."""
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml

        raw = yaml.safe_load(text) or {}
    raw = raw.get("detection_rules", raw)
    return {k: (v.get("severity", "MEDIUM"), v.get("description", ""), float(v.get("confidence_threshold", 0.5)), [p for p in v.get("patterns", []) if isinstance(p, str)]) for k, v in raw.items() if isinstance(v, dict)}


def overlay(base: Rules, custom: Rules) -> Rules:
    """Custom rules over the base."""
    return {**base, **custom}


def problems(spark: SparkSession, rules: Rules) -> list[str]:
    """What is wrong with rules (P27); patterns are compiled by Java's engine, which will run them."""
    found = []
    for name, (severity, _, threshold, patterns) in rules.items():
        if not patterns:
            found.append(f"{name}: no patterns")
        if severity not in SEVERITIES:
            found.append(f"{name}: severity {severity}")
        if not 0 <= threshold <= 1:
            found.append(f"{name}: threshold {threshold}")
        found += [f"{name}: pattern {p}" for p in patterns if not compiles(spark, p)]
    return found


def compiles(spark: SparkSession, pattern: str) -> bool:
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception as error:
        if "PatternSyntaxException" in str(error) or type(error).__name__ == "IllegalArgumentException":
            return False
        raise


def valid(spark: SparkSession, rules: Rules) -> Rules:
    """Rules without the patterns that don't compile, which a scan skips."""
    return {k: (s, d, t, [p for p in ps if compiles(spark, p)]) for k, (s, d, t, ps) in rules.items()}
