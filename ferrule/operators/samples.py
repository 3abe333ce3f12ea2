"""The line that a finding of obfuscated structure is about, and what of it is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import first_line, highest_entropy_line, lines
from .detect import longest_line, structure_score


def start_of(line: Column, pattern: str) -> Column:
    """Where the first match begins, from 0; -1 if there is none."""
    return F.regexp_instr(line, F.lit(pattern)) - 1


def legitimate_end(line: Column, start: Column) -> Column:
    """Where the last legitimate statement ends that does so before ``start``; 0 if none does."""
    ends = [start_of(line, p) + F.length(F.regexp_substr(line, F.lit(p))) for p in fixed.LEGITIMATE_ENDS]
    return F.greatest(*[F.when(end <= start, end).otherwise(0) for end in ends], F.lit(0))


def excerpt(text: Column, at: Column | int = 0) -> Column:
    """Part of a line, marked as cut at both ends."""
    return F.concat(F.lit("... "), F.substr(text, F.lit(1) + at, F.lit(fixed.SAMPLE)), F.lit("..."))


def beginning(line: Column) -> Column:
    return F.concat(F.substring(line, 1, fixed.WHOLE_SAMPLE), F.when(F.length(line) > fixed.WHOLE_SAMPLE, "...").otherwise(""))


def mangled_sample(line: Column) -> Column:
    """From the mangled names on if legitimate code stands before them, else the beginning of the line."""
    start = start_of(line, fixed.VARIABLE_MANGLING)
    return F.when((start >= 0) & (legitimate_end(line, start) > 0), excerpt(line, start)).otherwise(beginning(line))


def blob_sample(line: Column) -> Column:
    return F.when(start_of(line, fixed.VARIABLE_MANGLING) >= 0, mangled_sample(line)).otherwise(excerpt(line))


def appended_sample(line: Column) -> Column:
    """From the mangled names after the export on."""
    export = F.regexp_substr(line, F.lit(fixed.LEGITIMATE_ENDS[0]))
    rest = F.substr(line, start_of(line, fixed.LEGITIMATE_ENDS[0]) + F.length(export) + 1)
    start = start_of(rest, fixed.VARIABLE_MANGLING)
    return F.when(export.isNotNull() & (start >= 0), excerpt(rest, start)).otherwise(beginning(line))


def sampled(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with their structure's measures and score, and (sample_line, sample_code) of the first sign that a line shows.

    Signs are asked in order: mangled names, a blob's longest line, hex arrays, code after exports, entropy.  A sign that
    no single line shows leaves the choice to the next; files without any have nulls.  Lengths count code points.
    """
    scored = structure_score(files, content)
    own = lambda pattern: first_line(content, pattern)
    longest = longest_line(content)
    kinds = [
        ("mangled", F.when(F.col("mangling") > 0, own(fixed.VARIABLE_MANGLING))), ("blob", F.when((F.col("size") > fixed.BLOB_LENGTH) & (longest["line_length"] > fixed.LONG_LINE), longest["line_number"])),
        ("hex", F.when(F.col("hex_arrays") > 0, own(fixed.HEX_ARRAYS))), ("appended", F.when(F.col("appended") > 0, own(fixed.MODULE_EXPORT_APPENDED))),
    ]
    choice = F.coalesce(*[F.when(line.isNotNull(), F.struct(F.lit(kind).alias("kind"), line.cast("long").alias("line"))) for kind, line in kinds])
    chosen = scored.withColumn("choice_", choice)
    # Entropy by line is measured only where nothing else has a line.
    high = F.when(F.col("choice_").isNull() & (F.col("entropy") > F.col("entropy_limit")), F.col(content))
    chosen = chosen.withColumn("high_", highest_entropy_line(high, fixed.LINE_ENTROPY)["line_number"])
    at = F.coalesce("choice_.line", "high_")
    text = F.regexp_replace(F.try_element_at(lines(content), at.cast("int")), r"^\s+|\s+$", "")
    kind = F.col("choice_.kind")
    sample = F.when(kind == "mangled", mangled_sample(F.col("text_"))).when(kind == "blob", blob_sample(F.col("text_"))).when(kind == "appended", appended_sample(F.col("text_"))).otherwise(excerpt(F.col("text_")))
    return chosen.withColumn("sample_line", at).withColumn("text_", text).withColumn("sample_code", F.when(F.col("sample_line").isNotNull(), sample)).drop("choice_", "high_", "text_")
