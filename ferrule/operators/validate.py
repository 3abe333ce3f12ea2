"""Validators as columns: paths, names, versions, addresses, constraints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import any_match

# ---- Fixed values: path patterns; those of traversal ignore case. ----
TRAVERSAL = [r"\.\./", r"\.\.\\", r"\.\.%2f", r"\.\.%5c", r"\.\.%252f", r"\.\.%255c"]
INJECTION = [r"[;&|`$(){}\[\]]", r"\$\(", r"`[^`]*`", r"\$\{[^}]*\}"]
BLOCKED = ["/etc/passwd", "/etc/shadow", "/proc/", "/sys/", "C:\\Windows\\System32", "C:\\Windows\\SysWOW64"]
MAX_PATH = 4096


def path_threats(rows: DataFrame, path: str) -> DataFrame:
    """A row per path and threat (P22): too long, traversal, injection, and each blocked place."""
    p = F.col(path)
    made = lambda hit, kind, severity, confidence: F.when(hit, F.struct(F.lit(kind).alias("threat"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
    found = F.array(
        made(F.length(p) > MAX_PATH, "PATH_VALIDATION_ERROR", "MEDIUM", 0.7), made(any_match(p, [f"(?i){x}" for x in TRAVERSAL]), "PATH_TRAVERSAL", "HIGH", 0.9),
        made(any_match(p, INJECTION), "COMMAND_INJECTION", "CRITICAL", 0.8), *[made(p.contains(x), "PATH_VALIDATION_ERROR", "HIGH", 0.9) for x in BLOCKED],
    )
    return rows.select(path, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("t_")).select(path, "t_.*")


def package_name_error(name: Column) -> Column:
    """Why a package name is invalid; null if it is valid."""
    return (
        F.when(F.coalesce(F.length(F.trim(name)), F.lit(0)) == 0, "empty").when(F.length(name) > 214, "too long").when(name.rlike(r"\.\.|\x00"), "dangerous")
        .when(~name.rlike(r"^(@[a-z0-9~-][a-z0-9._~-]*/)?[a-z0-9~-][a-z0-9._~-]*$"), "format")
    )


def is_semver(version: Column) -> Column:
    return F.coalesce(version.rlike(r"^\d+\.\d+\.\d+(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"), F.lit(False))


def is_email(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def is_external_url(url: Column) -> Column:
    """An http or https address whose host isn't local or private."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.|0\.)")
    return F.coalesce((host != "") & ~private, F.lit(False))


def safe_entry(entry: Column) -> Column:
    """An archive entry that stays inside its folder."""
    return F.coalesce(~entry.startswith("/") & ~entry.rlike(r"(^|/)\.\.(/|$)") & ~entry.contains("\\") & ~entry.rlike(r"^[A-Za-z]:"), F.lit(False))


def file_checks(files: DataFrame, size: str, name: str, largest: int = 10 * 1024 * 1024, suffixes: tuple[str, ...] = (".exe", ".bat", ".cmd", ".scr", ".pif", ".vbs")) -> DataFrame:
    """Oversize files and suspicious suffixes."""
    suffix = F.lit(False)
    for s in suffixes:
        suffix = suffix | F.lower(F.col(name)).endswith(s)
    return files.withColumn("oversize", F.col(size) > largest).withColumn("suspicious_suffix", F.coalesce(suffix, F.lit(False)))


def constraint_errors(rows: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Rows with the names of the constraints they break (P25): required, min_length, max_length, pattern, allowed."""
    checks = []
    for column, rule in rules.items():
        c = F.col(column).cast("string")
        if rule.get("required"):
            checks.append(F.when(F.coalesce(c, F.lit("")) == "", f"{column}:required"))
        if "min_length" in rule:
            checks.append(F.when(F.length(c) < rule["min_length"], f"{column}:min_length"))
        if "max_length" in rule:
            checks.append(F.when(F.length(c) > rule["max_length"], f"{column}:max_length"))
        if "pattern" in rule:
            checks.append(F.when(~c.rlike(rule["pattern"]), f"{column}:pattern"))
        if "allowed" in rule:
            checks.append(F.when(~c.isin(rule["allowed"]), f"{column}:allowed"))
    return rows.withColumn("errors", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def option_errors(rows: DataFrame) -> DataFrame:
    """Scan options with the names of those out of bounds (P26); options not given are right."""
    whole = lambda c, low, high: (F.col(c) != F.floor(c)) | ~F.col(c).between(low, high)
    checks = [F.when(whole(c, low, high), c) for c, (low, high) in fixed.OPTION_BOUNDS.items()] + [F.when(~F.col("output").isin(fixed.OUTPUT_FORMATS), "output")]
    return rows.withColumn("errors", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def resolved(target: Column, root: str) -> Column:
    """An absolute path without ``.`` and ``..`` (P32); relative targets start at the root, empty and null ones are the root."""
    given = F.coalesce(F.nullif(F.trim(target), F.lit("")), F.lit("."))
    steps = F.split(F.when(given.startswith("/"), given).otherwise(F.concat(F.lit(root + "/"), given)), "/")
    kept = F.aggregate(
        F.filter(steps, lambda s: ~s.isin("", ".")), F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def inside_root(target: Column, root: str) -> Column:
    """Whether a target lies in the root (P32); one with a null byte never does."""
    root = "/" + root.strip("/")
    path = resolved(target, root)
    within = (path == root) | path.startswith(root if root == "/" else root + "/")
    return within & ~F.coalesce(target.contains("\0"), F.lit(False))


def any_of(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(any_match(text, [f"(?i){p}" for p in patterns]), F.lit(False))


def suspicious(text: Column) -> Column:
    """Calls that code hides behind."""
    return any_of(text, fixed.SUSPICIOUS_CALLS)


def dangerous(text: Column) -> Column:
    """Calls that load code, end processes or delete files."""
    return any_of(text, fixed.DANGEROUS_CALLS)


def malicious(text: Column) -> Column:
    """Signs of encoded or mangled code."""
    return any_of(text, fixed.MALICIOUS_CALLS)


def registry_name_error(name: Column) -> Column:
    """Why a name is refused before a registry is asked (P21): length, characters, first character, two dots; null if it isn't."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "empty").when(F.length(name) > fixed.NAME_LENGTH, "too long").when(~name.rlike(fixed.NAME_PATTERN), "characters").when(name.contains(".."), "dots")
    )


def safe_package_name(name: Column) -> Column:
    """Whether a name, scoped or not, holds no path and no command."""
    slash = F.instr(name, "/") - 1
    scope, rest = F.substring(name, F.lit(2), slash - 1), F.substr(name, slash + 2)
    scoped = (slash > 1) & (slash < F.length(name) - 1) & scope.rlike(fixed.NAME_PATTERN) & rest.rlike(fixed.NAME_PATTERN)
    clean = ~any_match(name, [f"(?i){p}" for p in TRAVERSAL]) & ~any_match(name, INJECTION)
    return F.coalesce((name != "") & clean & F.when(name.startswith("@"), scoped).otherwise(name.rlike(fixed.NAME_PATTERN)), F.lit(False))


def input_name_error(name: Column) -> Column:
    """Why a name or local path given by a user is refused (P21): scripts, format, suspicious words; null if it isn't."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "empty").when(any_of(name, fixed.SCRIPT_MARKS), "script").when(~(name.rlike(fixed.NAME_PATTERN) | name.rlike(fixed.LOCAL_PATH)), "format")
        .when(any_of(name, fixed.NAME_MARKS), "suspicious")
    )


def file_path_error(path: Column) -> Column:
    """Why a file's path is refused (P23): it leaves its folder or has another suffix; null if it isn't."""
    suffix = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+(\.[^.]*)$", 1))
    return F.when(F.coalesce(path, F.lit("")) == "", "empty").when(path.contains("..") | path.contains("~"), "dangerous").when((suffix != "") & ~suffix.isin(fixed.ALLOWED_SUFFIXES), "suffix")


def directory_path_error(path: Column) -> Column:
    """Why a directory's path is refused before it is looked up (P23); null if it isn't."""
    return F.when(F.coalesce(path, F.lit("")) == "", "empty").when(path.contains("..") | path.contains("~"), "dangerous")


@dataclass(frozen=True)
class Constraint:
    """What a field must be (P25); ``custom`` (X8) is a function from the field's column to a condition."""

    field: str
    required: bool = False
    type: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    allowed: tuple[str, ...] | None = None
    custom: Callable[[Column], Column] | None = None


#: Spark's types of the three that constraints name.
KINDS = {"string": {"string"}, "number": {"tinyint", "smallint", "int", "bigint", "float", "double"}, "boolean": {"boolean"}}


def constraint_of(c: Constraint, kind: str | None) -> Column:
    """The first thing that is wrong with a field, in words; null if nothing is."""
    value = F.col(c.field) if kind is not None else F.lit(None).cast("string")
    said = lambda text: F.lit(f"Field '{c.field}' {text}")
    checks: list[tuple[Column, Column]] = []
    if c.required:
        empty = value.isNull() | (value == "") if kind in (None, "string") else value.isNull()
        checks.append((empty, said("is required")))
    present = value.isNotNull()
    if c.type and kind is not None and kind not in KINDS.get(c.type, {c.type}) and not (c.type == "number" and kind.startswith("decimal")):
        checks.append((present, said(f"must be of type {c.type}")))
    if kind == "string":
        if c.min_length:
            checks.append((F.length(value) < c.min_length, said(f"must be at least {c.min_length} characters long")))
        if c.max_length:
            checks.append((F.length(value) > c.max_length, said(f"must be no more than {c.max_length} characters long")))
        if c.pattern:
            checks.append((~value.rlike(c.pattern), said("does not match required pattern")))
        if c.allowed is not None:
            checks.append((~value.isin(*c.allowed), said(f"must be one of: {', '.join(c.allowed)}")))
    if c.custom:
        checks.append((present & ~F.coalesce(c.custom(value), F.lit(False)), said("failed custom validation")))
    return F.coalesce(*[F.when(hit, text) for hit, text in checks], F.lit(None).cast("string"))


def validated(rows: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """Rows with ``errors``: one at most for each constraint, in their order, from one projection (P25).

    A field that the rows don't have is a missing one.  Null fields break only constraints that require them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = [constraint_of(c, kinds.get(c.field)) for c in constraints]
    return rows.withColumn("errors", F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>"))


def constraints_from(table: DataFrame, most: int = 1000) -> list[Constraint]:
    """Constraints from a table's rows (field, required, type, min_length, max_length, pattern, allowed), up to ``most`` of them, which compile to one projection."""
    rows = table.select(*[F.col(c) if c in table.columns else F.lit(None).alias(c) for c in ("field", "required", "type", "min_length", "max_length", "pattern", "allowed")]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} constraints")
    return [Constraint(r["field"], bool(r["required"]), r["type"], r["min_length"], r["max_length"], r["pattern"], None if r["allowed"] is None else tuple(r["allowed"])) for r in rows]
