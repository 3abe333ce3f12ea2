"""Pieces of DuckDB SQL that say the same as the library's expressions."""

from __future__ import annotations

from .. import fixed


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def total(text: str, patterns: list[str], prefix: str = "") -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({text}, {quoted(prefix + p)}))" for p in patterns) + ")"


def any_match(text: str, patterns: list[str], prefix: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {quoted(prefix + p)})" for p in patterns) + ")"


def imports_any(text: str, libraries: list[str]) -> str:
    forms = ['from "{}"', "from '{}'", "require('{}')", 'require("{}")']
    return "(" + " OR ".join(f"contains({text}, {quoted(f.format(lib))})" for lib in libraries for f in forms) + ")"


def entropy(text: str) -> str:
    share = f"((length({text}) - length(replace({text}, c, ''))) / length({text}))"
    return (
        f"CASE WHEN length({text}) > 0 THEN -list_sum(list_transform(list_filter(list_distinct(string_split({text}, '')), lambda c: c <> ''), "
        f"lambda c: {share} * log2({share}))) ELSE 0.0 END"
    )


def rule_rows(rules: dict) -> str:
    """A VALUES list (rule, severity, threshold, pattern_index, pattern, patterns)."""
    rows = [f"({quoted(r)}, {quoted(s)}, {t}::DOUBLE, {i}::BIGINT, {quoted(p)}, {len(ps)})" for r, (s, _, t, ps) in rules.items() for i, p in enumerate(ps)]
    return "(VALUES " + ", ".join(rows) + ") r(rule, severity, threshold, pattern_index, pattern, patterns)"


#: The severity that a line item stands for, by quantity, in the stand-in data.
SEVERITY = "CASE WHEN l_quantity >= 45 THEN 'CRITICAL' WHEN l_quantity >= 30 THEN 'HIGH' WHEN l_quantity >= 15 THEN 'MEDIUM' ELSE 'LOW' END"
#: The threat type that a line item stands for.
THREAT_TYPE = (
    "CASE l_linenumber WHEN 1 THEN 'DATA_EXFILTRATION' WHEN 2 THEN 'CRYPTO_MINING' WHEN 3 THEN 'MALICIOUS_CODE' WHEN 4 THEN 'PATH_TRAVERSAL' "
    "WHEN 5 THEN 'SUPPLY_CHAIN_ATTACK' WHEN 6 THEN 'SANDBOX_TIMEOUT' ELSE 'SUSPICIOUS_DEPENDENCY' END"
)


def is_test_file(path: str) -> str:
    marks = [f"contains({path}, {quoted(m)})" for m in fixed.TEST_MARKS] + [f"starts_with({path}, {quoted(m)})" for m in fixed.TEST_PREFIXES]
    return f"(NOT contains({path}, 'fixtures/') AND ({' OR '.join(marks)}))"
