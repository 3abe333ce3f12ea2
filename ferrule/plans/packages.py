"""Queries of package archives and of samples of code."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import functions as F

from .. import fixed
from ..operators import samples
from ..registry import query, table
from ..sources import archives
from . import sqltext as S


def packed(pages: pd.DataFrame) -> pd.Series:
    """A page as an archive: its text, its address, an entry that leaves the folder, and a link."""
    out = []
    for page_id, url, html in zip(pages["page_id"], pages["url"], pages["html"], strict=True):
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w:gz") as archive:
            for name, text in (("package/index.js", html or ""), ("package/lib/url.txt", url or ""), ("../evil.js" if page_id % 5 == 0 else "package/readme.md", "x")):
                content = text.encode()
                entry = tarfile.TarInfo(name)
                entry.size = len(content)
                archive.addfile(entry, io.BytesIO(content))
            if page_id % 3 == 0:
                link = tarfile.TarInfo("package/link")
                link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
                archive.addfile(link)
        cut = raw.getvalue()
        out.append(cut[: len(cut) // 2] if page_id % 50 == 49 else cut)
    return pd.Series(out)


LARGE = 6000


@query("package_entries", f"""
SELECT page_id, entry, CASE WHEN entry = 'package/link' THEN 'link' WHEN entry = '../evil.js' THEN 'unsafe path' WHEN strlen(content) > {LARGE} THEN 'too large' END AS problem,
  CASE WHEN entry IN ('package/link', '../evil.js') OR strlen(content) > {LARGE} THEN NULL ELSE sha256(content) END AS digest, CASE WHEN entry = 'package/link' THEN 0 ELSE strlen(content) END::BIGINT AS size
FROM (SELECT page_id, unnest(['package/index.js', 'package/lib/url.txt', CASE WHEN page_id % 5 = 0 THEN '../evil.js' ELSE 'package/readme.md' END] || CASE WHEN page_id % 3 = 0 THEN ['package/link'] ELSE [] END) AS entry,
  unnest([coalesce(html, ''), coalesce(url, ''), 'x'] || CASE WHEN page_id % 3 = 0 THEN [''] ELSE [] END) AS content FROM pages WHERE page_id % 50 <> 49)""")
def package_entries(spark, d):
    """Entries of archives that pages are packed into (S6, P29): unsafe and large ones as rows with their problem."""
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    raw = F.pandas_udf(packed, "binary")(F.struct("page_id", "url", "html"))
    found = archives.archive_entries(pages.select("page_id", raw.alias("raw")), "page_id", "raw", largest=LARGE)
    page = F.col("archive").cast("long")
    return found.where(page % 50 != 49).select(page.alias("page_id"), "entry", "problem", F.sha2("content", 256).alias("digest"), "size")


#: Parts as files of code that show every kind of sign, or none.
CODE = """(SELECT p_partkey AS file_id, '// ' || p_brand || chr(10) || CASE p_partkey % 8
  WHEN 0 THEN '  module.exports = ' || replace(p_name, ' ', '_') || '; const b3=I,c4=J; var rest = "' || p_name || '"; more(); and(more); still + more'
  WHEN 1 THEN 'const ab' || p_size || ' = X1, cd2 = Y2; ' || repeat(p_name || ' ', 6)
  WHEN 2 THEN 'let q = 1;' || chr(10) || '   ' || p_name || ' = [0x1f, 0x2e, 0x3d, 0x4c, 5]; ' || repeat('tail ', 20)
  WHEN 3 THEN p_name || chr(10) || repeat(p_name || ' ', 400)
  WHEN 4 THEN 'let a = 1; return b; const zz = Q, yy = R; ' || p_type || chr(10) || repeat(p_name || ' ', 400)
  WHEN 5 THEN 'aB3$dE5^gH7*jK9(mN1)pQ2_sT4+vW6-yZ8={}[]|:;<>,.?/~`' || p_partkey || chr(10) || p_name
  WHEN 6 THEN 'module.exports = a; const b3=I'
  ELSE p_name END AS content FROM part)"""


def mangled_sql(line: str, start: str) -> str:
    ends = ", ".join(f"CASE WHEN regexp_matches({line}, {S.quoted(p)}) AND instr({line}, regexp_extract({line}, {S.quoted(p)})) - 1 + length(regexp_extract({line}, {S.quoted(p)})) <= {start} THEN 1 ELSE 0 END" for p in fixed.LEGITIMATE_ENDS)
    return f"CASE WHEN {start} >= 0 AND greatest({ends}) > 0 THEN '... ' || substr({line}, {start} + 1, 60) || '...' ELSE substr({line}, 1, 80) || CASE WHEN length({line}) > 80 THEN '...' ELSE '' END END"


def start_sql(line: str) -> str:
    found = f"regexp_extract({line}, {S.quoted(fixed.VARIABLE_MANGLING)})"
    return f"CASE WHEN {found} = '' THEN -1 ELSE instr({line}, {found}) - 1 END"


def line_sql(pattern: str) -> str:
    return f"nullif(list_position(list_transform(lines, lambda x: regexp_matches(x, {S.quoted(pattern)})), true), 0)"


@query("sample_code", f"""
WITH f AS (SELECT *, string_split(content, chr(10)) AS lines FROM {CODE}),
k AS (SELECT *, {line_sql(fixed.VARIABLE_MANGLING)} AS m, CASE WHEN length(content) > 5000 THEN list_position(list_transform(lines, lambda x: length(x)), list_max(list_transform(lines, lambda x: length(x)))) END AS b,
  {line_sql(fixed.HEX_ARRAYS)} AS h, {line_sql(fixed.MODULE_EXPORT_APPENDED)} AS a, {S.entropy('content')} AS e FROM f),
l AS (SELECT file_id, arg_max(n, (e, -n)) AS n FROM (SELECT file_id, n, round({S.entropy('line')}, 9) AS e FROM (SELECT file_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM f)) WHERE e > 4.0 GROUP BY file_id),
c AS (SELECT k.*, coalesce(m, b, h, a, CASE WHEN e > 4.5 THEN l.n END) AS pos, CASE WHEN m IS NOT NULL THEN 'm' WHEN b IS NOT NULL THEN 'b' WHEN h IS NOT NULL THEN 'h' WHEN a IS NOT NULL THEN 'a' ELSE 'e' END AS kind
  FROM k LEFT JOIN l USING (file_id)),
t AS (SELECT *, trim(lines[pos], ' ' || chr(9)) AS line FROM c), s AS (SELECT *, {start_sql('line')} AS start, regexp_extract(line, {S.quoted(fixed.LEGITIMATE_ENDS[0])}) AS export FROM t),
x AS (SELECT *, substr(line, instr(line, export) + length(export)) AS rest FROM s)
SELECT file_id, pos::BIGINT AS sample_line, CASE WHEN pos IS NULL THEN NULL WHEN kind = 'm' OR kind = 'b' AND start >= 0 THEN {mangled_sql('line', 'start')}
  WHEN kind = 'a' THEN CASE WHEN export <> '' AND {start_sql('rest')} >= 0 THEN '... ' || substr(rest, {start_sql('rest')} + 1, 60) || '...' ELSE substr(line, 1, 80) || CASE WHEN length(line) > 80 THEN '...' ELSE '' END END
  ELSE '... ' || substr(line, 1, 60) || '...' END AS sample_code FROM x""")
def sample_code(spark, d):
    """The line and the part of it that a finding shows."""
    table(spark, d, "part").createOrReplaceTempView("ferrule_part")
    files = spark.sql("SELECT * FROM " + CODE.replace("FROM part", "FROM ferrule_part"))
    return samples.sampled(files).select("file_id", F.col("sample_line").cast("long").alias("sample_line"), "sample_code")
