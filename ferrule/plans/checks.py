"""Queries of validators and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import validate
from ..registry import query, table
from . import sqltext as S
from .standins import document_files

#: Parts as names, paths and code that validators accept or refuse.
GIVEN = """(SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN '' WHEN 1 THEN '@scope/' || p_size WHEN 2 THEN '@/x' WHEN 3 THEN '../' || p_size WHEN 4 THEN replace(p_name, ' ', '..') WHEN 5 THEN replace(p_name, ' ', '-') WHEN 6 THEN 'a' || chr(59) || p_size
  WHEN 7 THEN 'my-Malware-' || p_size WHEN 8 THEN './lib/' || p_size WHEN 9 THEN '<script>' WHEN 10 THEN '.hidden' ELSE repeat('ab', 110) END AS name,
  CASE p_partkey % 7 WHEN 0 THEN 'src/' || p_size || '.TS' WHEN 1 THEN 'a/../b.js' WHEN 2 THEN '~/x' WHEN 3 THEN 'run.exe' WHEN 4 THEN 'dir.v1/file' WHEN 5 THEN '' ELSE '.npmrc' END AS path,
  CASE p_partkey % 6 WHEN 0 THEN 'x.Replace (' WHEN 1 THEN 'CHILD_PROCESS' WHEN 2 THEN 'atob ( _0xfe' WHEN 3 THEN 'eval(import (fs.rmdir' ELSE p_name END AS code, p_size, p_brand FROM part)"""


def given(spark, d):
    table(spark, d, "part").createOrReplaceTempView("ferrule_part")
    return spark.sql("SELECT * FROM " + GIVEN.replace("FROM part", "FROM ferrule_part"))


PLAIN = f"regexp_matches(name, {S.quoted(fixed.NAME_PATTERN)})"
SCOPED = f"instr(name, '/') > 2 AND instr(name, '/') < length(name) AND regexp_matches(substr(name, 2, instr(name, '/') - 2), {S.quoted(fixed.NAME_PATTERN)}) AND regexp_matches(substr(name, instr(name, '/') + 1), {S.quoted(fixed.NAME_PATTERN)})"
SUFFIX = "lower(regexp_extract(string_split(path, '/')[-1], '^.+([.][^.]*)$', 1))"


@query("name_checks", f"""
SELECT p_partkey, CASE WHEN name = '' THEN 'empty' WHEN length(name) > 214 THEN 'too long' WHEN NOT {PLAIN} THEN 'characters' WHEN contains(name, '..') THEN 'dots' END AS registry_error,
  name <> '' AND NOT ({S.any_match('name', validate.TRAVERSAL, '(?i)')}) AND NOT ({S.any_match('name', validate.INJECTION)}) AND CASE WHEN starts_with(name, '@') THEN {SCOPED} ELSE {PLAIN} END AS safe,
  CASE WHEN name = '' THEN 'empty' WHEN {S.any_match('name', fixed.SCRIPT_MARKS, '(?i)')} THEN 'script' WHEN NOT ({PLAIN} OR regexp_matches(name, {S.quoted(fixed.LOCAL_PATH)})) THEN 'format' WHEN {S.any_match('name', fixed.NAME_MARKS, '(?i)')} THEN 'suspicious' END AS input_error,
  CASE WHEN path = '' THEN 'empty' WHEN contains(path, '..') OR contains(path, '~') THEN 'dangerous' WHEN {SUFFIX} <> '' AND {SUFFIX} NOT IN ({', '.join(map(S.quoted, fixed.ALLOWED_SUFFIXES))}) THEN 'suffix' END AS file_error,
  CASE WHEN path = '' THEN 'empty' WHEN contains(path, '..') OR contains(path, '~') THEN 'dangerous' END AS directory_error
FROM {GIVEN}""")
def name_checks(spark, d):
    """Names in the three readings (P21), and paths of files and folders."""
    name, path = F.col("name"), F.col("path")
    return given(spark, d).select(
        "p_partkey", validate.registry_name_error(name).alias("registry_error"), validate.safe_package_name(name).alias("safe"), validate.input_name_error(name).alias("input_error"),
        validate.file_path_error(path).alias("file_error"), validate.directory_path_error(path).alias("directory_error"),
    )


@query("call_patterns", f"""
SELECT file_id, {S.any_match('code', fixed.SUSPICIOUS_CALLS, '(?i)')} AS suspicious, {S.any_match('code', fixed.DANGEROUS_CALLS, '(?i)')} AS dangerous, {S.any_match('code', fixed.MALICIOUS_CALLS, '(?i)')} AS malicious
FROM (SELECT p_partkey AS file_id, code FROM {GIVEN} UNION ALL SELECT -doc_id, coalesce(text, '') FROM documents)""")
def call_patterns(spark, d):
    """Which calls code and texts hold."""
    code = given(spark, d).select(F.col("p_partkey").alias("file_id"), "code").unionByName(document_files(spark, d).select((-F.col("file_id")).alias("file_id"), F.col("content").alias("code")))
    text = F.col("code")
    return code.select("file_id", validate.suspicious(text).alias("suspicious"), validate.dangerous(text).alias("dangerous"), validate.malicious(text).alias("malicious"))


RULES = [
    validate.Constraint("name", required=True, type="string", min_length=3, max_length=40, pattern="^[a-zA-Z@.]"), validate.Constraint("p_size", type="string"), validate.Constraint("missing", required=True),
    validate.Constraint("p_brand", allowed=("Brand#1", "Brand#2", "Brand#3")), validate.Constraint("p_size", type="number", custom=lambda c: c % 5 != 0),
]


@query("constraint_report", """
SELECT p_partkey, rule, error FROM (SELECT p_partkey, unnest([1, 2, 3, 4, 5]) AS rule, unnest([
  CASE WHEN name = '' THEN 'Field ''name'' is required' WHEN length(name) < 3 THEN 'Field ''name'' must be at least 3 characters long' WHEN length(name) > 40 THEN 'Field ''name'' must be no more than 40 characters long'
    WHEN NOT regexp_matches(name, '^[a-zA-Z@.]') THEN 'Field ''name'' does not match required pattern' END,
  'Field ''p_size'' must be of type string', 'Field ''missing'' is required', CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'Field ''p_brand'' must be one of: Brand#1, Brand#2, Brand#3' END,
  CASE WHEN p_size % 5 = 0 THEN 'Field ''p_size'' failed custom validation' END]) AS error FROM {given}) WHERE error IS NOT NULL""".replace("{given}", GIVEN))
def constraint_report(spark, d):
    """The first thing wrong by row and constraint (P25), custom ones too."""
    found = validate.validated(given(spark, d), RULES)
    numbers = F.expr("CASE WHEN error LIKE '%''name''%' THEN 1 WHEN error LIKE '%type string' THEN 2 WHEN error LIKE '%missing%' THEN 3 WHEN error LIKE '%p_brand%' THEN 4 ELSE 5 END")
    return found.select("p_partkey", F.explode("errors").alias("error")).select("p_partkey", numbers.cast("int").alias("rule"), "error")
