"""Main text of web pages by nearest-URL page differencing.

A page becomes a list of text lines, one for each block, each with what its containers say about it.  Pages
are sorted by host and URL path; each is aligned with the nearest page of its host that isn't a near copy by
longest common subsequence, and shared lines are deleted as boilerplate.  Lines of containers that the
markup itself calls menus, forms, adverts, comments and the like go in any case, as those that differ from
page to page can't be told by differencing; an article inside a container with such a name only counts if
the page has no other.  Lines inside an ``<article>`` (or ``<main>``, or an articleBody) go by the same alignment, with the
nearest pages whose article differs; as neighbours may share a byline or a passage too, only those of the shared lines
go that half of the host's different articles repeat: its notices.  For the same reason a page isn't compared with its near copies, pages that
share half of what it has beyond the lines that the most different page of its host shares.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches, table

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul video audio".split()
)
#: Elements, roles and words of class and id whose content is not the article.
SKIP_TAGS = set("aside button canvas datalist dialog footer form head iframe input label menu nav noembed noframes noscript object option script select style svg template textarea title xmp".split())
SKIP_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SKIP_WORDS = set(
    "ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promotion recommended related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar tracking warning widget widgets".split()
)
HEADER_WORDS = {"header", "head", "hero"}
CONTENT_WORDS = set("article articlebody content entry main post story".split())
#: Elements that an open one of the same kind ends at, and those beyond which it isn't looked for.
ENDS_BEFORE = set("dd dt li option p td th tr".split())
HOLDS = set("article aside body div dl footer form header main nav ol section table ul".split())
#: A line's standing: in a container with an unlucky name, certainly not the article, undecided, in a container
#: named like content, in an article element inside a container with an unlucky name, in any other article element.
NAMED, NO, MAYBE, CONTENT, HIDDEN_ARTICLE, ARTICLE = -1, 0, 1, 2, 3, 4
#: Lines of the text that may go: undecided ones, and those inside an article.
OPEN, INSIDE = 1, 2
#: Different articles of a host from which on the lines that half of them repeat are its notices.
ARTICLES = 5
#: Pages that one task of the alignment holds.
CHUNK = 4096
#: Pages of the runs before and after that it holds too: all the nearest places that a page is paired with.
OVERLAP = 8


def standing(tag: str, attributes: str, outer: int) -> int:
    """Standing of an element's lines, given its parent's."""
    if outer == NO:
        return NO
    found: dict[str, str] = {}
    bare = set()
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        if m[2] is None and m[3] is None and m[4] is None:
            bare.add(m[1].lower())
        else:
            found[m[1].lower()] = html.unescape(m[2] or m[3] or m[4] or "")
    words = set(re.split(r"[\s_\-]+", f"{found.get('class', '')} {found.get('id', '')}".lower())) if found else set()
    role = found.get("role", "").lower()
    if tag not in ("html", "body"):
        if tag in SKIP_TAGS or role in SKIP_ROLES or "hidden" in bare | set(found) or found.get("aria-hidden", "").lower() == "true":
            return NO
        if "style" in found and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
            return NO
        if words & SKIP_WORDS:
            return NAMED if outer < HIDDEN_ARTICLE else NO
        if outer < CONTENT and (tag == "header" or words & HEADER_WORDS):
            return NAMED
    if tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return HIDDEN_ARTICLE if outer in (NAMED, HIDDEN_ARTICLE) else ARTICLE
    if outer > NO and words & CONTENT_WORDS and tag not in ("html", "body"):
        return max(outer, CONTENT)
    return outer


def page_lines(source: str) -> tuple[list[str], list[int]]:
    """The text of every block in page order, white space in it as single spaces, and each line's standing.

    One forward scan, in time that grows with the page's length however malformed it is.
    """
    lines: list[str] = []
    levels: list[int] = []
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # where each tag is open, and where blocks and containers are
    blocks: list[int] = []
    holders: list[int] = []
    open_text: list[str] = []
    level, at, size, last, quotes = MAYBE, 0, len(source), source.rfind(">"), True

    def flush() -> None:
        if open_text:
            text = " ".join(html.unescape("".join(open_text)).split())
            open_text.clear()
            if text:
                lines.append(text)
                levels.append(max(level, NO))

    def close(first: int) -> None:
        """Ends all elements from place ``first`` of the stack on."""
        nonlocal level
        if any(l != level for _, l in stack[first:]) or (stack[first - 1][1] if first else MAYBE) != level:
            flush()
        for tag, _ in stack[first:]:
            places[tag].pop()
        while blocks and blocks[-1] >= first:
            blocks.pop()
        while holders and holders[-1] >= first:
            holders.pop()
        del stack[first:]
        level = stack[-1][1] if stack else MAYBE

    while at < size:
        start = source.find("<", at)
        if start < 0 or start > last and not source.startswith("<!--", start):
            open_text.append(source[at:])  # no tag ends after this
            break
        open_text.append(source[at:start])
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        if source[start + 1 : start + 2] in ("!", "?"):
            at = source.find(">", start) + 1
            continue
        name = NAME.match(source, start + 1)
        if not name:
            open_text.append("<")
            at = start + 1
            continue
        at = source.find(">", name.end()) + 1
        attributes = source[name.end() : at - 1]
        if quotes and ("'" in attributes or '"' in attributes):
            end = QUOTED.match(source, name.end())
            if end:
                at = end.end()
                attributes = source[name.end() : at - 1]
            else:
                quotes = False  # one that never closes: from here on they mean nothing
        tag = name[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            if tag in BLOCKS:
                flush()
            if places.get(tag):
                first = places[tag][-1]
                if tag in BLOCKS or not blocks or blocks[-1] < first:  # an inline end tag doesn't close blocks
                    close(first)
            continue
        if tag == "br":
            open_text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if tag in ENDS_BEFORE and places.get(tag) and (not holders or holders[-1] < places[tag][-1]):
                close(places[tag][-1])
        if tag in VOID:
            continue
        inner = standing(tag, attributes, level)
        if tag in RAW:
            end = re.compile(rf"</{tag}", re.I | re.A).search(source, at)
            at = source.find(">", end.end()) + 1 or size if end else size
            continue
        if inner != level:
            flush()
        if not attributes.endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            if tag in HOLDS:
                holders.append(len(stack))
            stack.append((tag, inner))
            level = inner
    flush()
    return lines, levels


def candidates(levels: list[int]) -> np.ndarray:
    """Lines that may be the article: those of the highest standing on the page, if it is above ``NO``."""
    levels = np.array(levels, np.int64)
    best = int(levels.max()) if len(levels) else NO
    return (levels == best) & (best > NO)


#: Cells of a table of two pages' lines that is traced back as a whole, and columns of one step beyond.
WHOLE, COLUMNS = 1 << 22, 4096


def prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of longest common subsequences of ``a`` with every prefix of ``b``, ``COLUMNS`` of them at a time (bit-parallel)."""
    carries = bytearray(len(a))
    steps = []
    for start in range(0, len(b), COLUMNS):
        part = b[start : start + COLUMNS]
        width = len(part)
        places: dict[int, int] = {}
        for j, x in enumerate(part):
            places[x] = places.get(x, 0) | 1 << j
        v = full = (1 << width) - 1
        for i, x in enumerate(a):
            u = v & places.get(x, 0)
            total = v + u + carries[i]
            carries[i] = total >> width & 1
            v = (total | (v - u)) & full
        bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-width // 8), "little"), np.uint8), bitorder="little")[:width]
        steps.append(1 - bits.astype(np.int64))
    return np.concatenate([[0], np.cumsum(np.concatenate(steps))]) if steps else np.zeros(1, np.int64)


def traced(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by a bit row for each line of ``a``."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        v = rows[-1]
        u = v & places.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    found, i, j = [], len(a), len(b)
    while i and j:
        low = (1 << j) - 1
        here = (rows[i] & low).bit_count()
        if (rows[i - 1] & low).bit_count() == here:
            i -= 1
        elif (rows[i] & (low >> 1)).bit_count() == here - 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append(i)
    return found


def common_lines(a: list[int], b: list[int]) -> np.ndarray:
    """Which of ``a`` belong to a longest common subsequence with ``b``.

    Long pages are halved where the halves' lengths add up to the most, so memory grows with the number of
    lines and not with its square.
    """
    out = np.zeros(len(a), bool)
    both = set(a) & set(b)
    work = [([k for k, x in enumerate(a) if x in both], [x for x in b if x in both])]
    while work:
        rows, other = work.pop()
        head = 0
        while head < min(len(rows), len(other)) and a[rows[head]] == other[head]:
            out[rows[head]] = True
            head += 1
        tail = 0
        while tail < min(len(rows), len(other)) - head and a[rows[-1 - tail]] == other[-1 - tail]:
            out[rows[-1 - tail]] = True
            tail += 1
        rows, other = rows[head : len(rows) - tail], other[head : len(other) - tail]
        if not rows or not other:
            continue
        own = [a[k] for k in rows]
        if len(rows) == 1 or len(rows) * len(other) <= WHOLE:
            out[[rows[k] for k in traced(own, other)]] = True
            continue
        half = len(rows) // 2
        cut_at = int((prefix_lengths(own[:half], other) + prefix_lengths(own[half:][::-1], other[::-1])[::-1]).argmax())
        work += [(rows[:half], other[:cut_at]), (rows[half:], other[cut_at:])]
    return out


def split_url(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path
    except ValueError:
        return "", url or ""


def nearness(a: str, b: str) -> int:
    """Length of the common prefix of two paths."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def deletions(page: dict, others: list[dict]) -> np.ndarray:
    """Which lines of ``page`` go because the first of ``others``, the nearest first, that isn't a near copy has them too."""
    lines, sizes = page["lines"].tolist(), page["sizes"].astype(np.int64)
    shared = [common_lines(lines, other["lines"].tolist()) & page["open"] for other in others]
    own = page["open"] & ~min(shared, key=lambda s: sizes[s].sum())
    for s in shared:
        if sizes[s & own].sum() * 2 < sizes[own].sum():
            return s
    return np.zeros(len(lines), bool)  # there are only copies


def article_deletions(page: dict, others: list[dict], repeated: np.ndarray) -> np.ndarray:
    """Which lines inside ``page``'s article go: those that it shares, in order, with the articles of ``others`` that are no near copies of its own, and that are ``repeated``.

    An article of which half of what isn't repeated is in the other's is its near copy and no evidence.
    """
    lines, sizes, inside = page["lines"], page["sizes"].astype(np.int64), page["inside"]
    gone, often = np.zeros(len(lines), bool), inside & np.isin(lines, repeated)
    own = inside & ~often
    places = np.flatnonzero(inside)
    for other in others:
        if (gone == often).all():
            break
        shared = np.zeros(len(lines), bool)
        shared[places] = common_lines(lines[places].tolist(), other["lines"][other["inside"]].tolist())
        if sizes[shared & own].sum() * 2 < sizes[own].sum():
            gone |= shared & often
    return gone


def repeated_lines(pages: list[dict]) -> np.ndarray:
    """Lines that half of the different articles of one host's pages hold, none if these are fewer than ``ARTICLES``."""
    articles = {np.unique(p["lines"][p["inside"]]).tobytes() for p in pages if p["inside"].any()}
    if len(articles) < ARTICLES:
        return np.zeros(0, np.uint64)
    lines, counts = np.unique(np.concatenate([np.frombuffer(a, "<u8") for a in articles]), return_counts=True)
    return lines[counts * 2 >= len(articles)]


def places_around(at: int, low: int, high: int) -> list[int]:
    """Places from ``low`` up to ``high`` other than ``at``: all within 8, those at distances 16, 32, ..., and both ends.

    A run of near copies of any length is left in few steps.
    """
    steps = [*range(1, 9), *(16 << k for k in range((high - low).bit_length()))]
    return sorted({k for k in (low, high - 1, *(at - d for d in steps), *(at + d for d in steps)) if low <= k < high and k != at})


def content_key(host: str, lines: bytes, opens: bytes) -> int:
    """The key of pages of one host with the same lines, which are one page for the alignment."""
    x = xxhash.xxh3_64(host.encode("utf-8", "surrogatepass"))
    x.update(opens + lines)
    return x.intdigest() - (1 << 63)


def signature(url: str | None, texts: list[str], levels: list[int]) -> tuple[int, str, str, bytes, bytes]:
    """Key, host, path, hashed lines, and for each whether it is undecided, inside an article, or neither."""
    host, path = split_url(url)
    lines = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], "<u8").tobytes()
    opens = (candidates(levels) * np.where(np.array(levels, np.int64) < HIDDEN_ARTICLE, OPEN, INSIDE)).astype(np.uint8).tobytes()
    return content_key(host, lines, opens), host, path, lines, opens


def page_signatures(pages: DataFrame) -> DataFrame:
    """(row_key, host, path, lines, sizes, open): hashed lines, their lengths, and which may be deleted."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found, sizes = [], []
                for url, source in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    texts, levels = page_lines(source or "")
                    found.append(signature(url, texts, levels))
                    sizes.append(np.array([len(t) for t in texts], "<u4").tobytes())
                keys, hosts, paths, lines, opens = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(lines, pa.binary()), pa.array(sizes, pa.binary()), pa.array(opens, pa.binary())],
                    names=["row_key", "host", "path", "lines", "sizes", "open"],
                )

    return pages.select("url", "html").mapInArrow(run, "row_key long, host string, path string, lines binary, sizes binary, open binary")


def shared_lines(signatures: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, drop): for each page of which lines go, a byte per line.

    Pages with equal keys are one, at the least of their paths.
    Pages are numbered in the order of host, path and key, over all partitions, and dealt in runs of
    ``chunk`` with ``OVERLAP`` pages of overlap at either end; a host of any size is spread over many tasks.
    """
    order = ["host", "path", "row_key"]
    fields = ["path", "host", "lines", "sizes", "open"]
    once = signatures.groupBy("row_key").agg(F.min(F.struct(*fields)).alias("v")).select("row_key", *[f"v.{f}" for f in ("host", "path", "lines", "sizes", "open")])
    ordered = cut(once.repartitionByRange(partitions(signatures), *order).sortWithinPartitions(*order))
    counts = {r["p"]: r["n"] for r in ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, 0
    for p in sorted(counts):
        offsets[p], total = total, total + counts[p]

    def number(batches):
        from pyspark import TaskContext

        at = offsets.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], names=[*batch.schema.names, "place"])
            at += batch.num_rows

    placed = ordered.mapInArrow(number, "row_key long, host string, path string, lines binary, sizes binary, open binary, place long")
    runs = F.array_distinct(F.array(*[F.floor((F.col("place") + d) / F.lit(chunk)).cast("long") for d in (-OVERLAP, 0, OVERLAP)]))

    def align(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        pages = [{"lines": np.frombuffer(r.lines, "<u8"), "sizes": np.frombuffer(r.sizes, "<u4"), "open": np.frombuffer(r.open, np.uint8) == OPEN, "inside": np.frombuffer(r.open, np.uint8) == INSIDE} for r in pdf.itertuples()]
        hosts, paths = pdf["host"].to_numpy(), pdf["path"].tolist()
        borders = np.flatnonzero(np.r_[True, hosts[1:] != hosts[:-1], True]).tolist()
        repeated = [repeated_lines(pages[a:b]) for a, b in zip(borders, borders[1:], strict=False)]
        keys, drops = [], []
        for i, r in enumerate(pdf.itertuples()):
            if r.place // chunk != key[0]:
                continue
            turn = bisect_right(borders, i)
            inside = pages[i]["inside"]
            odd = len(repeated[turn - 1]) and np.isin(pages[i]["lines"][inside], repeated[turn - 1]).any()
            if not odd and not pages[i]["open"].any():
                continue
            near = sorted(places_around(i, borders[turn - 1], borders[turn]), key=lambda k: (-nearness(r.path, paths[k]), abs(k - i), k))
            if odd:
                gone = article_deletions(pages[i], [pages[k] for k in near], repeated[turn - 1])
                if gone.any() and (gone != inside).any():  # an article of nothing else stays
                    keys.append(r.row_key)
                    drops.append(gone.tobytes())
            if not pages[i]["open"].any():
                continue
            if near:
                gone = deletions(pages[i], [pages[k] for k in near])
                if gone.any():
                    keys.append(r.row_key)
                    drops.append(gone.tobytes())
        return pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "drop": drops})

    return placed.withColumn("run", F.explode(runs)).groupBy("run").applyInPandas(align, "key long, drop binary")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null or empty html gives an empty text; a null or malformed url belongs to the host ''.  Pages of a
    host with the same lines are one page for the alignment and get equal results.  Other columns are ignored.
    """
    keyed = small_batches(pages).select("page_id", "url", "html")
    drops = shared_lines(page_signatures(keyed))
    kind = pages.schema["page_id"].dataType.simpleString()

    def parse(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts, numbers, keys = [], [], []
                for url, source in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    lines, levels = page_lines(source or "")
                    keys.append(signature(url, lines, levels)[0])
                    own = np.nonzero(candidates(levels))[0]
                    texts.append("\n".join(lines[k] for k in own))
                    numbers.append(own.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(numbers, pa.binary())], names=["page_id", "url", "row_key", "text", "numbers"])

    def strip(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, (numbers, drop) in enumerate(zip(batch.column("numbers").to_pylist(), batch.column("drop").to_pylist(), strict=True)):
                if drop:
                    gone = np.frombuffer(drop, bool)[np.frombuffer(numbers, "<i4")]
                    texts[i] = "\n".join(t for t, g in zip(texts[i].split("\n"), gone, strict=True) if not g)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    parsed = keyed.mapInArrow(parse, f"page_id {kind}, url string, row_key long, text string, numbers binary")
    joined = parsed.join(drops, F.col("row_key") == F.col("key"), "left")
    return joined.select("page_id", "url", "text", "numbers", "drop").mapInArrow(strip, f"page_id {kind}, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
