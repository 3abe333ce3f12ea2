"""Alignment of two tokenizers over the same texts, and corpus-wide counts of the token pairs that overlap.

Both tokenizers end a token before a space or line feed that stands between two characters which aren't white space, and
neither joins anything across, so texts are cut there into units; units recur, and each is encoded and aligned once
for as long as a worker remembers it.  Tokens of the two sides whose bytes overlap are edges of a bipartite graph;
its connected components, found by union-find over the units at hand, are exactly the minimal groups of tokens that
end at the same byte, and every component's members expand into its links.

Each stretch of texts is written once as a row of two packed blocks: its documents as units with counts and its units as
pairs, and its pairs with counts.  Pairs are counted over all stretches; the counts go back to the stretches as plain
rows, sorted by Spark, and are added up by document in Python, one stretch at a time, so no task of Spark's holds the
answers of several.  Neither texts nor links are shuffled.
"""

from __future__ import annotations

import hashlib
import operator
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, least_labels, per_process, release, small_batches, sweep, table, trim

#: Characters of text in a stretch, and units that a worker remembers.
STRETCH, REMEMBERED = 4 << 20, 100_000
#: Texts without these are cut at every space and line feed.
ODD = re.compile(r"\s\s|[^\S \n]")
BORDER = re.compile(r"(?<=\S)(?=[ \n]\S)")
INNER = re.compile(r"\s")
SPACE = "▁"
LEADING = operator.itemgetter(slice(0, 1))
#: Units encoded at a time.
UNITS = 4_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def units_of(text: str) -> list[str]:
    """The text, after a space, cut into units."""
    text = " " + text
    if ODD.search(text):
        return BORDER.split(text)
    lines = text.split("\n")
    found = [" " + u for u in lines[0].split(" ")[1:]]
    for line in lines[1:]:
        first, *others = line.split(" ")
        found.append("\n" + first)
        found += [" " + u for u in others]
    return found


class Aligner:
    """Aligns units; remembers what it has found until it holds ``REMEMBERED`` units.

    A unit's record: numbers of tokens of A and of B, of groups and of links; its links' pairs (A's id and B's in one
    integer each); its groups as text, each with a semicolon after it; and whether both tokenizers give back its bytes.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(alphabet.__getitem__, entry)) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        self.lone_space = pieces.index(SPACE)
        shown = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.shown = np.array([[x + mark for x in shown] for mark in ",|;"], object)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts, self.fits, self.pairs = np.zeros((0, 4), np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.pair_ends = np.zeros(1, np.int64)

    def one_by_one(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """B puts a space before what it encodes: the unit's own, or one too many before a line feed, which is dropped."""
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for i, u in enumerate(units):
            if u[0] != " " and b[i][:1] == [self.lone_space]:
                del b[i][0]
            elif u == " ":
                b[i] = [self.lone_space]
        return a, b

    def learn(self, units: list[str]) -> None:
        """Units without inner white space are encoded together, as one text; the others each."""
        plain = [u for u in units if SPACE not in u and len(u) > 1 and not INNER.search(u, 1)]
        plain.sort(key=LEADING, reverse=True)  # those with a space first
        for at in range(0, len(plain), UNITS):
            some = plain[at : at + UNITS]
            raw = [u.encode() for u in some]
            text = "".join(some)
            start = 1 if text[0] == " " else 0
            a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            b = np.array(self.b.encode(text[1:] if start else text), np.int64)
            b = b if start else b[1:]
            if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == b"".join(raw) == b"".join(map(self.b_bytes.__getitem__, b.tolist())):
                self.remember(some, np.ones(len(some), bool), np.array(list(map(len, raw)), np.int64), a, b)
        rest = [u for u in units if u not in self.known]
        for at in range(0, len(rest), UNITS):
            some = rest[at : at + UNITS]
            raw = [u.encode() for u in some]
            ids_a, ids_b = self.one_by_one(some)
            fits = [b"".join(map(self.a_bytes.__getitem__, a)) == r == b"".join(map(self.b_bytes.__getitem__, b)) for r, a, b in zip(raw, ids_a, ids_b, strict=True)]
            flat = [np.array([t for own, ok in zip(ids, fits, strict=True) if ok for t in own], np.int64) for ids in (ids_a, ids_b)]
            self.remember(some, np.array(fits), np.array([len(r) if ok else 0 for r, ok in zip(raw, fits, strict=True)], np.int64), *flat)

    def remember(self, units: list[str], fits: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Records of units of ``sizes`` bytes (none where they don't fit), from the tokens of all in turn: both sides tile the same bytes."""
        end_a, end_b, ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.concatenate([[0], np.cumsum(sizes)])
        left, right = overlaps(end_a, end_b)
        own_a, own_b = groups(left, right, len(a), len(b))
        cut_a, cut_b = np.searchsorted(end_a, ends, side="right"), np.searchsorted(end_b, ends, side="right")
        cut_links = np.searchsorted(left, cut_a)
        last_a, last_b = np.append(own_a[1:] != own_a[:-1], True)[: len(a)], np.append(own_b[1:] != own_b[:-1], True)[: len(b)]
        until = np.concatenate([[0], np.cumsum(last_a)])[cut_a]
        self.counts = np.concatenate([self.counts, np.stack([np.diff(cut_a), np.diff(cut_b), np.diff(until), np.diff(cut_links)], axis=1)])
        self.fits = np.concatenate([self.fits, fits])
        self.pairs = np.concatenate([self.pairs, a[left] << 32 | b[right]])
        self.pair_ends = np.concatenate([self.pair_ends, self.pair_ends[-1] + cut_links[1:]])
        # Groups as text: A's tokens and then B's of each, with the mark that follows each token.
        order = np.argsort(np.concatenate([2 * own_a, 2 * own_b + 1]), kind="stable")
        marks = np.concatenate([last_a.astype(np.int8), 2 * last_b.astype(np.int8)])[order]
        parts = self.shown[marks, np.concatenate([a, b])[order]].tolist()
        start = 0
        first = len(self.known)
        for i, (unit, stop) in enumerate(zip(units, (cut_a + cut_b)[1:].tolist(), strict=True)):
            self.known[unit] = first + i
            self.texts.append("".join(parts[start:stop]))
            start = stop

    def units(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's units, in order; nothing for null and empty texts, or those that don't come back from both tokenizers."""
        cut = [units_of(t) if t else [] for t in texts]
        self.learn(list({u for own in cut for u in own}.difference(self.known)))
        numbers = [np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)) for own in cut]
        return [n if len(n) == 0 or self.fits[n].all() else n[:0] for n in numbers]

    def links_of(self, units: np.ndarray) -> np.ndarray:
        """Pairs of the units' links, one unit after the other."""
        sizes = self.counts[units, 3]
        return self.pairs[np.repeat(self.pair_ends[units] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


def overlaps(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of tokens whose byte ranges overlap, given the ends of tokens that tile the same bytes."""
    if not len(end_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start_a, start_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])
    first = np.searchsorted(end_b, start_a, side="right")
    count = np.searchsorted(start_b, end_a, side="left") - first
    left = np.repeat(np.arange(len(end_a)), count)
    return left, first[left] + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)


def groups(left: np.ndarray, right: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """The component of every token of A and of B in the graph of links, by union-find."""
    own = np.zeros(n_a + n_b, np.int64)
    if n_a:
        nodes, least = least_labels(left, right + n_a)
        own[nodes] = least
    return own[:n_a], own[n_a:]


def per_stretch(docs: DataFrame, a_path: str, b_path: str, make, kind: str) -> DataFrame:
    """What ``make`` gives for each stretch of texts: it is handed the aligner, the ids and the texts' units."""

    def run(batches):
        aligner = per_process(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))
        ids, found, size = [], [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                stop, some = at, 0
                while stop < len(texts) and (some < STRETCH // 8 or stop == at):
                    some += len(texts[stop] or "") + 64
                    stop += 1
                found += aligner.units(texts[at:stop])
                ids.append(batch.column("doc_id").slice(at, stop - at))
                size, at = size + some, stop
                if size > STRETCH:
                    yield make(aligner, pa.chunked_array(ids).combine_chunks(), found)
                    ids, found, size = [], [], 0
                    if len(aligner.known) > REMEMBERED:
                        aligner.forget()
        if found:
            yield make(aligner, pa.chunked_array(ids).combine_chunks(), found)
        if len(aligner.known) > REMEMBERED:
            aligner.forget()
        trim()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def aligned_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, groups) of every row: its groups of token ids in order, as "a1,a2|b1;a3|b2,b3"; '' for a text without tokens."""

    def make(aligner, ids, found):
        shown = ["".join(map(aligner.texts.__getitem__, own.tolist()))[:-1] for own in found]
        return pa.RecordBatch.from_arrays([ids, pa.array(shown, pa.string())], names=["doc_id", "groups"])

    return per_stretch(docs, a_path, b_path, make, "doc_id long, groups string")


#: Rows of pairs handed to Spark at a time.
PAIR_ROWS = 1 << 15


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed block."""
    sink = pa.BufferOutputStream()
    batch = [pa.array(a.astype(np.int32) if len(a) == 0 or (a.min() >= -(1 << 31) and a.max() < 1 << 31) else a) for a in arrays]
    longest = max(map(len, batch))
    columns = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in batch] if longest else [pa.array([[]], pa.list_(pa.int32())) for _ in batch]
    record = pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(batch))])
    with pa.ipc.new_stream(sink, record.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(record)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> list[np.ndarray]:
    record = pa.ipc.open_stream(block).read_next_batch()
    return [c.flatten().to_numpy().astype(np.int64) for c in record.columns]


def stretches(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(stretch, doc_id, marks, units, pairs): a row a stretch, documents with their hashes and two packed blocks.

    ``units`` has the documents' four numbers, how many distinct units each has, those units and how often it has them, how
    many links each unit has and which pair each link is; ``pairs`` has the distinct pairs and how many links hold them.
    """

    def listed(values, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))

    def make(aligner, ids, found):
        own, place = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_inverse=True)
        sizes = np.array([len(f) for f in found])
        doc = np.repeat(np.arange(len(found)), sizes)
        both, times = np.unique(doc * max(1, len(own)) + place, return_counts=True)
        doc, unit = np.divmod(both, max(1, len(own)))
        counts = aligner.counts[own]
        numbers = np.zeros((len(found), 4), np.int64)
        np.add.at(numbers, doc, counts[unit] * times[:, None])
        texts = aligner.texts
        marks = [hashlib.sha256("".join(map(texts.__getitem__, f.tolist()))[:-1].encode()).hexdigest() if len(f) else "" for f in found]
        pair, of_unit = np.unique(aligner.links_of(own), return_inverse=True)
        used = np.bincount(unit, times, minlength=len(own)).astype(np.int64)
        links = np.bincount(of_unit, np.repeat(used, counts[:, 3]), minlength=len(pair)).astype(np.int64)
        units = packed(numbers.ravel(), np.bincount(doc, minlength=len(found)), unit, times, counts[:, 3], of_unit)
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().int >> 65], pa.int64()), listed(ids, pa.int64()), listed(marks, pa.string()), pa.array([units], pa.binary()), pa.array([packed(pair, links)], pa.binary())],
            names=["stretch", "doc_id", "marks", "units", "pairs"],
        )

    return per_stretch(docs, a_path, b_path, make, "stretch long, doc_id array<long>, marks array<string>, units binary, pairs binary")


def pair_rows(written: DataFrame) -> DataFrame:
    """(stretch, at, pair, links) of every pair of every stretch."""

    def run(batches):
        release()
        for batch in batches:
            for name, block in zip(batch.column("stretch").to_pylist(), batch.column("pairs"), strict=True):
                pair, links = unpacked(block.as_py())
                for at in range(0, len(pair), PAIR_ROWS):
                    some = pair[at : at + PAIR_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), name)), pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.array(some), pa.array(links[at : at + PAIR_ROWS])], names=["stretch", "at", "pair", "links"])

    return written.select("stretch", "pairs").mapInArrow(run, "stretch long, at int, pair long, links long")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A pair's count is the number of links that hold it over all rows; ``n_best`` counts links whose pair is the most
    frequent of its B id (ties included), ``count_sum`` adds up the counts of a document's links.  Null and empty texts,
    and texts that either tokenizer doesn't give back byte by byte, have zeros and ''.  Repeated rows count and come
    out each, rows with a null id too.  Further columns aren't read; no rows give no rows.  The stretches are written
    to the shared folder, so that a text is encoded once and a stretch keeps its name.
    """
    written = cut(stretches(docs, a_path, b_path))
    pairs = pair_rows(written)
    counted = pairs.groupBy("pair").agg(F.sum("links").alias("n")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    best = counted.groupBy(F.col("b").alias("of_b")).agg(F.max("n").alias("most"))
    weights = cut(counted.join(best, F.col("b") == F.col("of_b")).select(F.col("pair").alias("same"), "n", (F.col("n") == F.col("most")).alias("best")))
    sweep(docs.sparkSession)
    answers = pairs.select("stretch", "at", "pair").join(weights, F.col("pair") == F.col("same")).select("stretch", "at", "n", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, marks = (left.column(c).combine_chunks().flatten() for c in ("doc_id", "marks"))
        numbers, doc_units, unit, times, unit_pairs, unit_pair = unpacked(left.column("units")[0].as_py())
        weight = np.zeros((max(1, right.num_rows), 2), np.int64)
        at = right.column("at").to_numpy()
        weight[at, 0], weight[at, 1] = right.column("best").cast(pa.int64()).to_numpy(), right.column("n").to_numpy()
        per_unit = np.zeros((len(unit_pairs), 2), np.int64)
        np.add.at(per_unit, np.repeat(np.arange(len(unit_pairs)), unit_pairs), weight[unit_pair])
        numbers = numbers.reshape(-1, 4)
        per_doc = np.zeros((len(numbers), 2), np.int64)
        np.add.at(per_doc, np.repeat(np.arange(len(numbers)), doc_units), per_unit[unit] * times[:, None])
        trim()
        return pa.Table.from_arrays(
            [ids, *(pa.array(numbers[:, j]) for j in range(4)), pa.array(per_doc[:, 0]), pa.array(per_doc[:, 1]), marks],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        )

    joined = written.select("stretch", "doc_id", "marks", "units").groupBy("stretch").cogroup(answers.groupBy("stretch"))
    return joined.applyInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
