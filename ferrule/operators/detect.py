"""Detectors over files: a DataFrame with a path and a content column in, threats or measures out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import any_match, basename, contains_any, entropy, first_line, highest_entropy_line, imports_any, lines, matches, reaches

Rules = dict[str, tuple[str, str, float, list[str]]]


def rule_matches(rules: Rules, content: str = "content") -> Column:
    """An array of (rule, pattern_index, pattern, severity, threshold, matches) of all patterns that match."""
    rows = []
    for rule, (severity, _, threshold, patterns) in rules.items():
        for i, pattern in enumerate(patterns):
            rows.append(F.struct(
                F.lit(rule).alias("rule"), F.lit(i).cast("long").alias("pattern_index"), F.lit(pattern).alias("pattern"), F.lit(severity).alias("severity"),
                F.lit(threshold).alias("threshold"), matches(content, f"(?i){pattern}").cast("long").alias("matches"),
            ))
    return F.filter(F.array(*rows), lambda r: r["matches"] > 0)


def rule_confidence(hit: Column) -> Column:
    return F.least(F.lit(0.95), hit["threshold"] + 0.1 * hit["matches"])


def rule_hits(files: DataFrame, rules: Rules, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """A row per file, rule and pattern that matches (J1), and one per rule with several matching patterns.

    The rules are unrolled into the projection, so every pattern is a constant that a task compiles once; no
    join and no shuffle.
    """
    keep = keep or [c for c in files.columns if c != content]
    # Exploded with its nulls: for a plain one Spark would put a filter on the array's size first and match everything twice.
    hits = files.select(*keep, F.explode_outer(rule_matches(rules, content)).alias("hit_")).where("hit_ IS NOT NULL")
    return hits.select(*keep, *[f"hit_.{c}" for c in ("rule", "pattern_index", "pattern", "severity", "matches")], rule_confidence(F.col("hit_")).alias("confidence"))


def rule_groups(files: DataFrame, rules: Rules, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Per file and rule with more than one matching pattern: how many match and the aggregate confidence."""
    keep = keep or [c for c in files.columns if c != content]
    rows = []
    for rule, (severity, _, _, patterns) in rules.items():
        n = reduce(lambda a, b: a + b, [F.when(F.col(content).rlike(f"(?i){p}"), 1).otherwise(0) for p in patterns])
        rows.append(F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), n.cast("long").alias("patterns_hit"), F.least(F.lit(0.95), n / F.lit(len(patterns)) * 0.8).alias("confidence")))
    found = files.select(*keep, F.explode(F.array(*rows)).alias("r_")).select(*keep, "r_.*")
    return found.where("patterns_hit > 1")


def whitelist_flags(content: str = "content") -> dict[str, Column]:
    """Classifiers of legitimate code, each by a total number of matches."""
    return {
        "utility": reaches(content, fixed.UTILITY, 3),
        "server": reaches(content, fixed.SERVER, 5),
        "testing": reaches(content, fixed.TESTING, 2),
        "blockchain": reaches(content, fixed.BLOCKCHAIN, 2),
        "socket": reaches(content, fixed.SOCKET_EVENTS, 3),
        "shader": reaches(content, fixed.SHADER, 3),
        "graphics": (reaches(content, fixed.THREE_JS, 5)) | any_match(content, fixed.OTHER_GRAPHICS) | imports_any(content, fixed.GRAPHICS_IMPORTS),
        "react": is_react(content),
    }


def is_react(content: str = "content") -> Column:
    return (reaches(content, fixed.REACT, 3)) | imports_any(content, fixed.REACT_IMPORTS)


#: Classifiers that end the analysis, in order.
SUPPRESSING = ["shader", "graphics", "socket", "utility", "server", "testing", "blockchain"]


def classify(files: DataFrame, content: str = "content") -> DataFrame:
    """All flags, and the first that suppresses findings as ``suppressed_by``."""
    flagged = files.select("*", F.struct(*[v.alias(k) for k, v in whitelist_flags(content).items()]).alias("flags_"))
    first = F.coalesce(*[F.when(F.col(f"flags_.{k}"), F.lit(k)) for k in SUPPRESSING])
    return flagged.withColumn("suppressed_by", first).select(*files.columns, "flags_.*", "suppressed_by")


def is_test_file(path: Column) -> Column:
    """Test files by their path (P3); none below a fixtures folder, so that fixtures are scanned."""
    marked = contains_any(path, fixed.TEST_MARKS)
    for prefix in fixed.TEST_PREFIXES:
        marked = marked | path.startswith(prefix)
    return F.coalesce(~path.contains("fixtures/") & marked, F.lit(False))


def is_config_file(path: Column) -> Column:
    """Config and dot files, config extensions, vendored and graphics paths."""
    name = basename(path)
    return F.coalesce(
        name.isin(fixed.CONFIG_FILES + fixed.DOT_FILES) | reduce(lambda a, b: a | b, [name.endswith(x) for x in fixed.CONFIG_EXTENSIONS])
        | contains_any(path, fixed.EXCLUDED_DIRECTORIES) | contains_any(F.lower(path), fixed.GRAPHICS_FILES), F.lit(False)
    )


def suspicious_modules(files: DataFrame, content: str = "content", path: str = "file_path") -> DataFrame:
    """A row per file and required module that can run code or touch files (P35): single quotes only."""
    found = F.filter(F.array(*[F.lit(m) for m in fixed.SUSPICIOUS_MODULES]), lambda m: F.col(content).contains(F.concat(F.lit("require('"), m, F.lit("')"))))
    quiet = is_test_file(F.col(path)) | is_config_file(F.col(path))
    return files.withColumn("module", F.explode(found)).select(
        path, "module", F.when(quiet, "LOW").otherwise("CRITICAL").alias("severity"), F.lit(0.9).alias("confidence")
    )


def structure_score(files: DataFrame, content: str = "content") -> DataFrame:
    """Points for obfuscated structure, capped (A8): mangled names, size, hex arrays, appended exports, entropy.

    React code has a higher limit of entropy; whether a file is such code is asked only where that decides.
    """
    points = fixed.STRUCTURE_POINTS
    measured = files.select(
        "*", matches(content, fixed.VARIABLE_MANGLING).cast("long").alias("mangling"), F.length(content).cast("long").alias("size"), matches(content, fixed.HEX_ARRAYS).cast("long").alias("hex_arrays"),
        matches(content, fixed.MODULE_EXPORT_APPENDED).cast("long").alias("appended"), entropy(content).alias("entropy"),
    )
    between = (F.col("entropy") > fixed.ENTROPY_LIMIT) & (F.col("entropy") <= fixed.ENTROPY_LIMIT_REACT)
    measured = measured.withColumn("entropy_limit", F.when(between & is_react(content), fixed.ENTROPY_LIMIT_REACT).otherwise(fixed.ENTROPY_LIMIT))
    flags = {
        "mangling": F.col("mangling") > 0, "blob": F.col("size") > fixed.BLOB_LENGTH, "hex": F.col("hex_arrays") > 0,
        "append": F.col("appended") > 0, "entropy": F.col("entropy") > F.col("entropy_limit"),
    }
    total = reduce(lambda a, b: a + b, [F.when(flags[k], p).otherwise(0) for k, p in points.items()])
    count = reduce(lambda a, b: a + b, [flags[k].cast("int") for k in points])
    return measured.withColumn("structure_score", F.least(total, F.lit(fixed.STRUCTURE_CAP)).cast("long")).withColumn("threat_count", F.coalesce(count, F.lit(0)).cast("long"))


def wallet_threats(files: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Wallet threat families (F17): a row per file and matching pattern."""
    keep = keep or [c for c in files.columns if c != content]
    rows = []
    for family, (severity, patterns) in fixed.WALLET_FAMILIES.items():
        for i, pattern in enumerate(patterns):
            n = matches(content, f"(?i){pattern}")
            rows.append(F.struct(F.lit(f"WALLET_{family.upper()}").alias("type"), F.lit(i).cast("long").alias("pattern_index"), F.lit(severity).alias("severity"), n.cast("long").alias("matches"), F.least(F.lit(0.95), 0.7 + 0.1 * n).alias("confidence")))
    return files.select(*keep, F.explode(F.filter(F.array(*rows), lambda r: r["matches"] > 0)).alias("t_")).select(*keep, "t_.*")


def has_high_entropy(content: str = "content") -> Column:
    """More than 30% of the lines are long and hold three or more random-looking runs."""
    own = lines(content)
    odd = F.filter(own, lambda x: (F.length(x) > 100) & (F.regexp_count(x, F.lit("[a-zA-Z0-9]{20,}")) > 2))
    return F.size(odd) > 0.3 * F.size(own)


def has_wallet_keywords(content: str = "content") -> Column:
    return contains_any(F.lower(content), fixed.WALLET_KEYWORDS)


def longest_line(content: str = "content") -> Column:
    """(line_number, length) of the longest line, the first on ties."""
    own = F.transform(lines(content), lambda x, i: F.struct(F.length(x).cast("long").alias("size"), (-i).cast("long").alias("minus")))
    top = F.array_max(own)
    return F.struct((1 - top["minus"]).alias("line_number"), top["size"].alias("line_length"))


__all__ = [
    "classify", "first_line", "has_high_entropy", "has_wallet_keywords", "highest_entropy_line", "is_config_file", "is_react", "is_test_file",
    "longest_line", "rule_groups", "rule_hits", "structure_score", "suspicious_modules", "wallet_threats", "whitelist_flags",
]
