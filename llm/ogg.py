"""Ogg containers as media columns.

Writing: packets are laced into pages with checksums and granule positions; logical streams interleave.
Reading: pages are found by their capture pattern, checked against their checksum, demultiplexed by serial
number, and packets are put together again from lacing values, over page borders too.  A damaged page is
left out and the packets that it cuts are dropped; reading goes on at the next capture pattern.  Times
come from granule positions and the rate that a stream's first packet states.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, small_batches, table, text_bytes

CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = "<4sBBqIIIB"
#: Each byte with its bits in reverse order.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
RATE = 8000
#: Samples in a packet: ten seconds, so a packet can span pages.
PACKET = 10 * RATE
RAW8, SUMS = b"\x01raw8\x00", b"\x01sums\x00"


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04c11db7, most significant bit first, no initial or final inversion).

    It is the usual reflected CRC-32 of the bit-reversed bytes, reversed, so zlib computes it.
    """
    reflected = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(REVERSED), "big")


def make_page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = struct.pack(HEADER, b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def write_stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets are (bytes, granule position at its end).

    The first packet has a page of its own.  A page's granule position is that of the last packet ending
    on it, or -1 if none does.
    """
    pages: list[bytes] = []
    lacing, body, granule, flags = bytearray(), bytearray(), -1, FIRST

    def flush(more: bool) -> None:
        nonlocal lacing, body, granule, flags
        pages.append(make_page(flags, granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing, body, granule, flags = bytearray(), bytearray(), -1, CONTINUED if more else 0

    for i, (packet, end) in enumerate(packets):
        values, at = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255]), 0
        while values:
            fit = values[: 255 - len(lacing)]
            size = sum(fit)
            lacing += fit
            body += packet[at : at + size]
            at, values = at + size, values[len(fit) :]
            if not values:
                granule = end
            if i == len(packets) - 1 and not values:
                flags |= LAST
            if len(lacing) == 255 or i == 0 or flags & LAST:
                flush(bool(values))
    return pages


def write_ogg(streams: list[tuple[int, list[tuple[bytes, int]]]]) -> bytes:
    """All first pages, then the other pages of all streams in turn."""
    every = [write_stream(*s) for s in streams]
    out = [pages[0] for pages in every]
    for i in range(1, max(map(len, every))):
        out += [pages[i] for pages in every if i < len(pages)]
    return b"".join(out)


def read_pages(data: bytes) -> Iterator[tuple[int, dict | None]]:
    """(offset, page) of each page; None for a capture pattern whose page is cut short or fails its checksum."""
    at = data.find(b"OggS")
    while at >= 0:
        page, size = None, 4
        if at + 27 <= len(data):
            _, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEADER, data, at)
            lacing = data[at + 27 : at + 27 + n]
            whole = 27 + n + sum(lacing)
            if version == 0 and len(lacing) == n and at + whole <= len(data):
                raw = data[at : at + whole]
                if page_checksum(raw[:22] + b"\0\0\0\0" + raw[26:]) == crc:
                    page, size = {"flags": flags, "granule": granule, "serial": serial, "number": number, "lacing": lacing, "body": raw[27 + n :]}, whole
        yield at, page
        at = data.find(b"OggS", at + size)


def granule_rate(first: bytes) -> tuple[str, int | None, int]:
    """Codec, granules a second and granules to leave out at the start, from a stream's first packet."""
    if first.startswith(RAW8) and len(first) >= 12:
        return "raw8", struct.unpack_from("<I", first, len(RAW8) + 1)[0] or None, 0
    if first.startswith(SUMS) and len(first) >= 10:
        return "sums", struct.unpack_from("<I", first, len(SUMS))[0] or None, 0
    if first.startswith(b"\x01vorbis") and len(first) >= 16:
        return "vorbis", struct.unpack_from("<I", first, 12)[0] or None, 0
    if first.startswith(b"OpusHead") and len(first) >= 12:
        return "opus", 48000, struct.unpack_from("<H", first, 10)[0]
    if first.startswith(b"\x7fFLAC") and len(first) >= 30:
        return "flac", (int.from_bytes(first[27:30], "big") >> 4) or None, 0
    if first.startswith(b"Speex   ") and len(first) >= 40:
        return "speex", struct.unpack_from("<I", first, 36)[0] or None, 0
    return "unknown", None, 0


def read_ogg(data: bytes) -> dict:
    """{'pages', 'bad_pages', 'streams': {serial: stream}, 'chain': [(serial, link, stream)]}.

    Of streams that follow each other under one serial number, as in chained files, ``streams`` holds the last
    and ``chain`` all, in the order of their first pages; ``link`` counts those of one serial.

    A stream has codec, rate, pages, gaps (missing page numbers), ended, packets [(bytes, granule or None,
    seconds or None)]; only the packet that ends last on a page has a granule position of its own.
    """
    streams: dict[int, dict] = {}
    chain: list[tuple[int, int, dict]] = []
    pages = bad = 0
    for _, page in read_pages(data):
        if page is None:
            bad += 1
            continue
        pages += 1
        serial = page["serial"]
        if serial not in streams or page["flags"] & FIRST and streams[serial]["ended"]:
            streams[serial] = {"codec": "unknown", "rate": None, "skip": 0, "pages": 0, "gaps": 0, "ended": False, "packets": [], "open": None, "next": page["number"]}
            chain.append((serial, sum(k == serial for k, _, _ in chain), streams[serial]))
        s = streams[serial]
        if page["number"] != s["next"]:
            s["gaps"] += 1
            s["open"] = None
        s["next"] = page["number"] + 1
        s["pages"] += 1
        parts = s["open"] if page["flags"] & CONTINUED else None
        orphan = bool(page["flags"] & CONTINUED) and parts is None  # the start of this packet is lost
        parts, at, ended = parts or [], 0, []
        run = 0
        for value in page["lacing"]:
            run += value
            if value < 255:
                parts.append(page["body"][at : at + run])
                at, run = at + run, 0
                if not orphan:
                    ended.append(b"".join(parts))
                parts, orphan = [], False
        if run or page["lacing"][-1:] == b"\xff":
            parts.append(page["body"][at : at + run])
            s["open"] = None if orphan else parts
        else:
            s["open"] = None
        for i, packet in enumerate(ended):
            if not s["packets"]:
                s["codec"], s["rate"], s["skip"] = granule_rate(packet)
            granule = page["granule"] if i == len(ended) - 1 and page["granule"] >= 0 else None
            seconds = max(0, granule - s["skip"]) / s["rate"] if granule is not None and s["rate"] else None
            s["packets"].append((packet, granule, seconds))
        s["ended"] |= bool(page["flags"] & LAST)
    return {"pages": pages, "bad_pages": bad, "streams": streams, "chain": chain}


def samples_to_ogg(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """Unsigned 8-bit samples as stream 1; stream 2 carries a checksum of each of its packets."""
    audio, sums = [(RAW8 + b"\x01" + struct.pack("<IQ", rate, len(payload)), 0)], [(SUMS + struct.pack("<I", rate), 0)]
    for at in range(0, len(payload), packet):
        part = payload[at : at + packet]
        audio.append((part, at + len(part)))
        sums.append((struct.pack("<I", zlib.crc32(part)), at + len(part)))
    return write_ogg([(1, audio), (2, sums)])


def ogg_to_samples(media: bytes) -> tuple[bytes, dict]:
    """The samples of stream 1, checked against stream 2, and what reading found."""
    found = read_ogg(media)
    audio, sums = (found["streams"].get(k, {"packets": []})["packets"] for k in (1, 2))
    found["mismatches"] = sum(zlib.crc32(a[0]) != int.from_bytes(b[0], "little") for a, b in zip(audio[1:], sums[1:], strict=False)) + abs(len(audio) - len(sums))
    return b"".join(p[0] for p in audio[1:]), found


def samples_feature(payload: bytes, found: dict) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    audio = found["streams"].get(1, {"packets": []})
    seconds = next((p[2] for p in reversed(audio["packets"]) if p[2] is not None), 0.0)
    p = np.bincount(x + 128, minlength=256) / max(1, len(x))
    p = p[p > 0]
    turns = int(np.count_nonzero(np.diff(np.signbit(x)))) if len(x) else 0
    rms = float(np.sqrt(np.mean(np.square(x)))) if len(x) else 0.0
    return (
        f"streams={len(found['streams'])};pages={found['pages']};packets={sum(len(s['packets']) for s in found['streams'].values())};"
        f"bad={found['bad_pages']};mismatches={found['mismatches']};seconds={seconds:.6f};rms={rms:.4f};"
        f"crossings={turns};peak={int(np.abs(x).max()) if len(x) else 0};entropy={max(0.0, float(-(p * np.log2(p)).sum())):.4f}"
    )


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """(id, n_bytes, media): every whole text, padded with bytes 0 to a positive multiple of ``unit``, as an Ogg file.

    A null text is stored like an empty one.  Other columns are left out, whatever their names.
    """

    def run(batches):
        for batch in chunks(batches, text_col):
            texts = [t or b"" for t in text_bytes(batch.column(text_col))]
            media = [samples_to_ogg(t + bytes(-len(t) % unit or (0 if t else unit))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return small_batches(df).select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def decode_media(df: DataFrame) -> DataFrame:
    """(id, n_bytes, ...) with digests and features of the samples read back from ``media``."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = []
                for media in part.column("media").to_pylist():
                    payload, found = ogg_to_samples(media)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), samples_feature(payload, found)))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    kind = df.schema["id"].dataType.simpleString()
    return small_batches(df).mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def read_packets(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row per packet of every Ogg file: (id, serial, link, codec, packet, n_bytes, granule, seconds, data).

    Null, empty or foreign bytes give no rows.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                part = batch.slice(start, 16)
                rows = []
                for key, media in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for serial, link, s in read_ogg(media or b"")["chain"]:
                        rows += [(key, serial, link, s["codec"], i, len(p), g, t, p) for i, (p, g, t) in enumerate(s["packets"])]
                kinds = [part.column(0).type, pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "serial", "link", "codec", "packet", "n_bytes", "granule", "seconds", "data"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, media_col).mapInArrow(run, f"id {kind}, serial long, link int, codec string, packet int, n_bytes long, granule long, seconds double, data binary")


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(encode_texts(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
