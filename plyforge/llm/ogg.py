"""Ogg media columns: pages with checksums, packets by lacing values, multiplexed logical streams, granule times.

A payload of bytes becomes a physical stream of two logical PCM streams: blocks of 576 samples alternate between them,
each block is one packet, and the granule position of a page counts the samples of its stream up to the last packet that
ends on it. Every stream begins with a header packet ("PCM8", rate, serial order) on a page of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plyforge.llm.textio import chunks, pick, small_batches

BLOCK = 576
RATE = 8000
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


def page_checksum(page: bytes) -> int:
    """CRC of polynomial 04C11DB7, not reflected, from 0: the mirror of zlib's over mirrored bytes."""
    c = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(serial: int, seq: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, seq, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def lacing_of(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


@dataclass
class Writer:
    """Packets of one logical stream to pages of at most 255 lacing values; a long packet runs over several pages."""

    serial: int
    seq: int = 0

    def pages(self, packets: list[bytes], granules: list[int], last: bool, first: bool = False) -> Iterator[bytes]:
        lacing, body, granule, fresh = bytearray(), bytearray(), -1, True
        begin = first
        for p, g in zip(packets, granules, strict=True):
            at, laces = 0, lacing_of(len(p))
            while laces:
                if len(lacing) == 255:
                    yield self._out(lacing, body, granule, (0 if fresh else 1) | (2 if begin else 0))
                    fresh, begin, granule = at == 0, False, -1
                    lacing, body = bytearray(), bytearray()
                part, laces = laces[: 255 - len(lacing)], laces[255 - len(lacing) :]
                size = sum(part)
                lacing += part
                body += p[at : at + size]
                at += size
                if not laces:
                    granule = g
        yield self._out(lacing, body, granule, (0 if fresh else 1) | (2 if begin else 0) | (4 if last else 0))

    def _out(self, lacing: bytearray, body: bytearray, granule: int, flags: int) -> bytes:
        self.seq += 1
        return _page(self.serial, self.seq - 1, granule, flags, bytes(lacing), bytes(body))


@dataclass
class Stream:
    """A logical stream as read: packets, the sample count at each page's end, and whether its end page came."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    marks: list[tuple[int, int]] = field(default_factory=list)  # (packets so far, granule position)
    seq: int = -1
    partial: bytes = b""
    ended: bool = False

    def times(self) -> list[float]:
        """Start second of every data packet, from the granule position of the page on which it ends."""
        out: list[float] = []
        for count, granule in self.marks:
            done = len(out)
            for i in range(done, count - 1):  # the header packet carries no samples
                out.append((granule - (count - 1 - i) * BLOCK) / RATE)
        return out


class OggError(ValueError):
    pass


def read_streams(media: bytes) -> list[Stream]:
    """All logical streams by order of their first page; raises OggError on a bad page, checksum, sequence or open packet."""
    at, streams = 0, {}
    while at < len(media):
        if len(media) - at < 27:
            raise OggError("cut page header")
        magic, version, flags, granule, serial, seq, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        size = sum(lacing)
        end = at + 27 + n + size
        if len(lacing) < n or end > len(media):
            raise OggError("cut page")
        page = media[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"bad checksum at byte {at}")
        if flags & 2:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or seq != s.seq + 1:
            raise OggError(f"page {seq} of stream {serial} is out of order")
        if bool(s.partial) != bool(flags & 1):
            raise OggError("a continued packet doesn't fit")
        s.seq, s.ended = seq, bool(flags & 4)
        body, pos, begin, whole = page[27 + n :], 0, 0, 0
        for lace in lacing:
            pos += lace
            if lace < 255:
                s.packets.append(s.partial + body[begin:pos])
                s.partial, begin, whole = b"", pos, whole + 1
        s.partial += body[begin:]
        if whole:
            if granule < 0:
                raise OggError("a page that ends a packet has no granule position")
            s.marks.append((len(s.packets), granule))
        at = end
    for s in streams.values():
        if s.partial or not s.ended:
            raise OggError(f"stream {s.serial} is cut")
    return list(streams.values())


def padded(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of BLOCK."""
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def mux(payload: bytes) -> bytes:
    """The physical stream of a payload whose length is a positive multiple of BLOCK. Equal payloads, equal bytes."""
    base = zlib.crc32(payload)
    writers = [Writer(base), Writer(base ^ 0x80000000)]
    out = []
    for k, w in enumerate(writers):
        out += w.pages([b"PCM8" + struct.pack("<IB", RATE, k)], [0], False, True)
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    page = []
    for k, w in enumerate(writers):
        own = blocks[k::2]
        runs = [own[s : s + 85] for s in range(0, len(own), 85)] or [[]]
        page.append([p for r, run in enumerate(runs) for p in w.pages(run, [BLOCK * (85 * r + i + 1) for i in range(len(run))], r == len(runs) - 1)])
    for i in range(max(map(len, page))):  # the streams' pages alternate
        out += [p[i] for p in page if i < len(p)]
    return b"".join(out)


def demux(media: bytes) -> tuple[bytes, list[Stream]]:
    """(payload, streams) of what mux made; raises OggError if it isn't whole."""
    streams = read_streams(media)
    if len(streams) != 2 or any(not s.packets or s.packets[0] != b"PCM8" + struct.pack("<IB", RATE, k) for k, s in enumerate(streams)):
        raise OggError("not a pair of PCM streams")
    own = [s.packets[1:] for s in streams]
    total = sum(map(len, own))
    if len(own[0]) - len(own[1]) not in (0, 1):
        raise OggError("blocks are missing")
    out: list[bytes] = [b""] * total
    out[0::2], out[1::2] = own
    for s, blocks in zip(streams, own, strict=True):
        if blocks and s.marks[-1][1] != sum(map(len, blocks)):
            raise OggError("the last granule position isn't the number of samples")
    return b"".join(out), streams


def features(payload: bytes, streams: list[Stream]) -> str:
    """Seconds and blocks of each stream, then mean, spread and zero crossings of the samples about their midpoint."""
    x = np.frombuffer(payload, np.uint8)
    high = x > 127
    seconds = ";".join(f"{len(s.packets) - 1}x{BLOCK}@{s.times()[-1]:.3f}" if len(s.packets) > 1 else "0" for s in streams)
    n = len(x)
    total, square = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.uint16).sum(dtype=np.int64))
    mean = total / n
    spread = max(0.0, square / n - mean * mean) ** 0.5
    return f"{seconds}|mean={mean:.4f}|sd={spread:.4f}|crossings={int(np.count_nonzero(high[1:] != high[:-1]))}"


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary): the padded UTF-8 bytes of each whole text as Ogg."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in chunks(batch.column(1)):
                raw = data.tobytes()
                media = [mux(padded(raw[a:b])) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(media, pa.binary())], names=["id", "media"])

    return pick(docs, id_col, text_col).mapInArrow(run, "id long, media binary").withColumnRenamed("id", id_col)


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): each whole text stored
    as Ogg, read back with all checks, and described from what was read.

    Null text counts as empty, whose payload is one block of 255. Repeated rows come back as often as they came; other
    columns aren't read; an empty table gives an empty result. A stored stream that doesn't read back raises OggError.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in chunks(batch.column(1)):
                raw = data.tobytes()
                rows = []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    media = mux(padded(raw[a:b]))
                    payload, streams = demux(media)
                    rows.append((b - a, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, streams)))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), *cols], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kinds = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return pick(docs, id_col, text_col).mapInArrow(run, kinds).withColumnRenamed("id", id_col)
