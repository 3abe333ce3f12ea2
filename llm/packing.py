"""Packing documents into token sequences.

Documents are tokenised and dealt into random groups.  Within a group, whole sequences are cut off long
documents, and the rests are packed first-fit decreasing; a tournament tree over the free room of all
bins finds the first bin that fits in logarithmic time.  The emptiest bins are then dissolved: their
documents are cut to fill what room the other bins have left.  Token ids never move: each document
carries the checksums of its blocks of ``BLOCK`` ids, from which that of any piece is composed.
"""

from __future__ import annotations

import contextlib
import gc
import os
import zlib
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, per_process, small_batches, table, text_bytes

LENGTH, BLOCK, EOT = 4096, 64, 2
#: Bytes of text in a group; the number of groups grows with the input.
GROUP_BYTES = 4 << 20
#: Bytes of text encoded at a time: few enough that the words stay in the processor's cache.
ENCODE_BYTES = 1 << 18
ALL = 0xFFFFFFFF
ZEROS = bytes(4 * BLOCK)


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two byte strings together from those of each; the second has at most a block's bytes."""
    return zlib.crc32(ZEROS[:second_bytes], first ^ ALL) ^ ALL ^ second


class Encoder:
    """Token ids, as little-endian 32-bit integers, by white-space-separated chunk.

    The tokenizer drops white space and never joins anything across it, so a text's ids are those of its
    chunks in turn; chunks recur, so most are looked up.  It lower-cases, and never joins a letter to a
    mark, so ASCII capitals and trailing marks needn't be told apart in the lookup either.
    """

    MARKS = b".,!?;:*#$%&"

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.limit, self.known, self.old = Tokenizer.from_file(path), limit, {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, chunks: list[bytes]) -> None:
        known, old, whole, split = self.known, self.old, set(), []
        strip, marks = bytes.rstrip, self.MARKS
        for chunk in chunks:
            core = strip(chunk, marks)
            size = len(core)
            if 0 < size < len(chunk) and (core[-1:].isalpha() if core[-1] < 128 else core.decode()[-1].isalpha()):
                tail = chunk[size:]
                split.append((chunk, core, tail))
                for w in (core, tail):
                    if w not in known:
                        if w in old:
                            known[w] = old[w]
                        else:
                            whole.add(w)
            else:
                whole.add(chunk)
        letters = [w for w in whole if (w if w.isascii() else w.decode()).isalpha()]
        whole.difference_update(letters)
        rest = list(whole)
        for at in range(0, len(letters), 20_000):
            rest += self.learn_letters(letters[at : at + 20_000])
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for chunk, found in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[chunk] = np.array(found.ids, "<u4").tobytes()
        for chunk, core, tail in split:
            known[chunk] = known[core] + known[tail]

    def learn_letters(self, words: list[bytes]) -> list[bytes]:
        """Encodes words of letters in one call, cut where a token ends a word; all words, if some hold more than one such end."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.nonzero(self.ending[ids])[0] + 1
        if len(ends) != len(words):
            return words
        raw, start = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist(), strict=True):
            self.known[word], start = raw[start:end], end
        return []

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self.known) > self.limit:  # chunks that recur come over from the older half when they are next met
            self.known, self.old = {}, self.known
        known, old, words, ends = self.known, self.old, [], []
        for text in texts:
            if text:  # special tokens are found before lower-casing, so a text that may hold one keeps its case
                words += (text if b"<|" in text else text.lower()).split()
            ends.append(len(words))
        parts = list(map(known.get, words))
        gaps, at = [], -1
        with contextlib.suppress(ValueError):
            while True:
                at = parts.index(None, at + 1)
                gaps.append(at)
        unknown = {words[i] for i in gaps}
        known.update((w, old[w]) for w in unknown if w in old)
        self.learn([w for w in unknown if w not in known])
        for i in gaps:
            parts[i] = known[words[i]]
        return [b"".join(parts[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def block_sums(ids: bytes) -> bytes:
    step = 4 * BLOCK
    return np.array([zlib.crc32(ids[at : at + step]) for at in range(0, len(ids), step)], "<u4").tobytes()


def token_blocks(docs: DataFrame, tokenizer: str, eot: int = EOT) -> DataFrame:
    """(doc_id, doc_tokens, sums) of every whole text; a null text is an empty one and has only the end id."""
    end = np.array([eot], "<u4").tobytes()

    def run(batches):
        encoder = per_process(("encoder", tokenizer), lambda: Encoder(tokenizer))
        gc.disable()  # many small lists and tuples, and no cycles: looking for these costs a sixth of the time
        try:
            for batch in chunks(batches, "text", ENCODE_BYTES):
                ids = [x + end for x in encoder.encode(text_bytes(batch.column("text")))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(block_sums, ids), pa.binary())], names=["doc_id", "doc_tokens", "sums"])
        finally:
            gc.enable()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, doc_tokens long, sums binary")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, taken in the order given (longest first), each put into the first bin with room.

    ``room`` is a tournament tree: a leaf for each bin, each inner node the largest room below it.
    """
    leaves = 1 << max(0, (max(1, len(sizes)) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins = np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i] = node - leaves
        room[node] -= size
        node //= 2
        while node:
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return bins


def pack_group(tokens: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> list[tuple[int, int, int, int, int]]:
    """(row, start, length, sequence, offset) of the pieces of a group's documents, given their token counts."""
    pieces, whole = [], 0
    for row, n in enumerate(tokens.tolist()):
        for start in range(0, n - n % length, length):
            pieces.append((row, start, length, whole, 0))
            whole += 1
    rest = tokens % length
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    bins: list[list[tuple[int, int, int]]] = []
    for row, at in zip(order.tolist(), first_fit_decreasing(rest[order], length).tolist(), strict=True):
        while at >= len(bins):
            bins.append([])
        bins[at].append((row, int(tokens[row] - rest[row]), int(rest[row])))
    room = [length - sum(p[2] for p in b) for b in bins]
    by_room = sorted(range(len(bins)), key=lambda i: (room[i], i))
    usable = sum(r // block * block for r in room)
    gaps = deque(i for i in by_room if room[i] >= block)  # filled from the left, dissolved from the right
    while len(gaps) > 1:
        donor = gaps[-1]
        own = room[donor] // block * block
        if length - room[donor] + block * len(bins[donor]) > usable - own:
            break
        gaps.pop()
        usable -= own
        for row, start, size in bins[donor]:
            while size:
                at = gaps[0]
                cut = min(size, room[at] // block * block) if size > room[at] else size
                bins[at].append((row, start, cut))
                usable -= room[at] // block * block
                room[at] -= cut
                usable += room[at] // block * block
                start, size = start + cut, size - cut
                if room[at] < block:
                    gaps.popleft()
        bins[donor], room[donor] = [], length
    for own in bins:
        if own:
            offset = 0
            for row, start, size in own:
                pieces.append((row, start, size, whole, offset))
                offset += size
            whole += 1
    return pieces


def piece_crc(sums: np.ndarray, start: int, size: int, block: int = BLOCK) -> int:
    """crc32 of ids [start, start + size); start is a multiple of the block, and so is the end or it is the document's."""
    out, at = 0, start // block
    while size > 0:
        step = min(size, block)
        out = joined_crc(out, int(sums[at]), 4 * step)
        at, size = at + 1, size - step
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, eot: int = EOT, group_bytes: int = GROUP_BYTES, seed: int = 5) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    Null ids and repeated rows are packed like any other rows; an empty table gives no pieces.  Groups are
    random and of bounded expected size, so a source, length or text that many rows share is spread.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    groups = max(1, -(-int(total["b"] or 0) // group_bytes), int(total["n"]) // 50_000)
    dealt = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()), F.lit(groups)).alias("g")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "doc_tokens"], kind="stable", na_position="last").reset_index(drop=True)
        sums = [np.frombuffer(x, "<u4") for x in pdf["sums"]]
        pieces = pack_group(pdf["doc_tokens"].to_numpy(), length)
        rows = np.array([p[0] for p in pieces])
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].to_numpy()[rows], "start": [p[1] for p in pieces], "length": [p[2] for p in pieces],
            "ids_crc32": [piece_crc(sums[p[0]], p[1], p[2]) for p in pieces], "doc_tokens": pdf["doc_tokens"].to_numpy()[rows],
            "sequence_id": [(int(key[0]) << 32) + p[3] for p in pieces], "offset": [p[4] for p in pieces],
        })

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return token_blocks(docs, tokenizer, eot).select("*", dealt).groupBy("g").applyInPandas(run, kind)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
