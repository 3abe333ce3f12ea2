"""Text expressions: pattern counts, entropy, lines, escaping.  All but entropy are built-in functions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_boundary(pattern: str) -> str:
    r"""A pattern with ``\b`` on ASCII letters, digits and underscore only, for Java's regular expressions."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)


def required_text(pattern: str) -> str:
    """The longest plain text that every match of a pattern holds, as far as that is easily seen; else an empty one.

    Groups, classes and escapes of kinds of characters are passed over; a choice at the top has no such text.
    """
    best, run, i = "", "", 0
    while i < len(pattern):
        c, kept, own = pattern[i], False, ""
        if c == "|":
            return ""
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if nxt.isalnum() and nxt not in "sSdDwWbBntr":
                return ""
            own = "" if nxt.isalnum() else nxt
            i += 2
        elif c == "[":
            i += 2 if pattern[i + 1 : i + 2] in ("]", "\\") else 1
            while i < len(pattern) and pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
            i += 1
        elif c == "(":
            depth = 0
            while i < len(pattern):
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[":
                    i += 1
                    while i < len(pattern) and pattern[i] != "]":
                        i += 2 if pattern[i] == "\\" else 1
                else:
                    depth += (pattern[i] == "(") - (pattern[i] == ")")
                i += 1
                if not depth:
                    break
        else:
            own = "" if c in ".^$" else c
            i += 1
        follow = pattern[i : i + 1]
        if follow in ("*", "?", "{"):
            own = ""
            i = pattern.index("}", i) + 1 if follow == "{" else i + 1
        elif follow == "+":
            kept = True
            i += 1
        if pattern[i : i + 1] in ("?", "+") and follow in ("*", "?", "{", "+") and follow:
            i += 1  # lazy or possessive
        run = run + own if own else ""
        best = max(best, run, key=len)
        if kept:
            run = ""
    return best


def may_match(text: Column, pattern: str) -> Column | None:
    """A cheap test that holds wherever the pattern matches, or none."""
    plain = required_text(pattern.removeprefix("(?i)"))
    if not plain or not plain.isascii() or "(?" in pattern.removeprefix("(?i)")[:2]:
        return None
    return F.lower(text).contains(plain.lower()) if pattern.startswith("(?i)") else text.contains(plain)


def matches(text: str | Column, pattern: str) -> Column:
    """How often a pattern occurs; 0 for null.  Texts without the plain text that it asks for are not searched."""
    count, gate = F.regexp_count(col(text), F.lit(pattern)), may_match(col(text), pattern)
    return F.coalesce(count if gate is None else F.when(gate, count), F.lit(0))


def reaches(text: str | Column, patterns: list[str], least: int) -> Column:
    """Whether all patterns together occur ``least`` times; counting stops as soon as they have.

    The patterns are data rather than code: dozens of them in one projection are more code than the JVM compiles at once,
    and compiling a pattern takes far less than searching a file for it.
    """
    own = col(text)
    gates = [required_text(p) for p in patterns]
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(g if g and g.isascii() and "(?" not in p[:2] else "").alias("gate")) for p, g in zip(patterns, gates, strict=True)])
    step = lambda n, p: F.when((n < least) & own.contains(p["gate"]), n + F.regexp_count(own, p["pattern"])).otherwise(n)
    return F.coalesce(F.aggregate(rows, F.lit(0), step) >= least, F.lit(False))


def total_matches(text: str | Column, patterns: list[str]) -> Column:
    """Occurrences of all patterns together (F16)."""
    return reduce(lambda a, b: a + b, [matches(text, p) for p in patterns])


def any_match(text: str | Column, patterns: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [col(text).rlike(p) for p in patterns]), F.lit(False))


def contains_any(text: str | Column, words: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [col(text).contains(w) for w in words]), F.lit(False))


def imports_any(text: str | Column, libraries: list[str]) -> Column:
    """Whether a text imports one of the libraries; their names are looked for only behind the words that import any."""
    forms = [f'from "{{}}"', "from '{}'", "require('{}')", 'require("{}")']
    begun = contains_any(text, [form.split("{")[0] for form in forms])
    return begun & contains_any(text, [form.format(lib) for lib in libraries for form in forms])


#: Code points and counters that one step of the entropy handles at a time.
SIGNS, COUNTERS = 1 << 20, 1 << 23


def bits_per_sign(texts: list[str]) -> np.ndarray:
    """Shannon entropy of each string's code points, in bits; 0 for an empty one."""
    out = np.zeros(len(texts))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SIGNS, side="right")))
        codes = np.frombuffer("".join(texts[at:stop]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes):
            used = np.flatnonzero(np.bincount(codes))
            place = np.zeros(int(used[-1]) + 1, np.int64)
            place[used] = np.arange(len(used))
            codes = place[codes]
            step, n = max(1, COUNTERS // len(used)), sizes[at:stop]
            first = np.concatenate([[0], np.cumsum(n)])
            for k in range(0, stop - at, step):
                last = min(k + step, stop - at)
                own = codes[first[k] : first[last]] + np.repeat(np.arange(last - k) * len(used), n[k:last])
                share = np.bincount(own, minlength=(last - k) * len(used)).reshape(-1, len(used)) / np.maximum(n[k:last, None], 1)
                logs = np.zeros_like(share)
                np.log2(share, out=logs, where=share > 0)
                out[at + k : at + last] = -(share * logs).sum(1) + 0.0
        at = stop
    return out


def entropy(text: str | Column) -> Column:
    """Shannon entropy in bits of the characters (A7); 0 for null.

    Counting characters with built-in functions takes a pass over the text for each distinct one, or a shuffle;
    a vectorised function counts those of a whole batch in one.
    """

    @F.pandas_udf("double")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series(bits_per_sign(texts.fillna("").tolist()))

    return measure(col(text))


def highest_entropy_line(text: str | Column, least: float) -> Column:
    """(line_number, line_entropy) of the line with most entropy above ``least``, the first on ties; null if there is none."""

    @F.pandas_udf("line_number long, line_entropy double")
    def measure(texts: pd.Series) -> pd.DataFrame:
        split = [t.split("\n") for t in texts.fillna("")]
        bits = np.round(bits_per_sign([line for own in split for line in own]), 9)
        first = np.concatenate([[0], np.cumsum([len(own) for own in split])])[:-1].astype(np.int64)
        top = np.maximum.reduceat(bits, first) if len(first) else bits
        owner = np.repeat(np.arange(len(split)), [len(own) for own in split])
        best = np.flatnonzero(bits == top[owner])
        numbers = np.full(len(split), 0, np.int64)
        numbers[owner[best][::-1]] = (best - first[owner[best]] + 1)[::-1]  # the first of equals is written last
        found = top > least
        return pd.DataFrame({"line_number": pd.Series(numbers).where(found).astype("Int64"), "line_entropy": pd.Series(top).where(found)})

    return measure(col(text))


def lines(text: str | Column) -> Column:
    return F.split(col(text), "\n")


def first_line(text: str | Column, pattern: str) -> Column:
    """Number, from 1, of the first line with a match; null if there is none."""
    at = F.array_position(F.transform(lines(text), lambda x: x.rlike(pattern)), True)
    return F.when(at > 0, at)


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def html_escape(text: str | Column) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def markdown_escape(text: str | Column) -> Column:
    return F.replace(F.regexp_replace(col(text), r"\n", " "), F.lit("|"), F.lit("\\|"))


def sanitize(text: str | Column, limit: int = 1000) -> Column:
    """Without control characters, cut and trimmed."""
    return F.trim(F.substring(F.regexp_replace(col(text), r"[\x00-\x1F\x7F-\x{9F}]", ""), 1, limit))


def round2(x: Column) -> Column:
    """Two decimals, halves upwards."""
    return F.floor(x * 100 + 0.5) / 100
