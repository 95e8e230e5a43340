"""Media columns: texts as payloads of Ogg containers, written, read back and described.

The container (RFC 3533): pages with a checksum, packets cut into lacing values of at most 255, logical streams told
apart by serial number, and granule positions from which timestamps follow. A payload is dealt packet by packet over
two logical streams, so that reading it back demultiplexes, reassembles and reorders.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import released, table, text_buffer

#: Bits of each byte in reverse: the checksum of a page is a CRC-32 that takes bits from the top.
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
PAYLOAD_UNIT = 192
#: Bytes of payload in a packet; a page holds as many packets as its 255 lacing values allow.
PACKET_BYTES = 8 * PAYLOAD_UNIT
SAMPLE_RATE = 8_000
MAGIC = b"\x01tessera"
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    """The bytes are no intact Ogg file."""


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, start 0, bits from the top, no final complement.

    It is the mirror image of zlib's CRC, so bytes and result are reversed bit by bit.
    """
    mirrored = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    blank = head + body
    return head[:22] + struct.pack("<I", page_checksum(blank)) + head[26:] + body


def mux(payload: bytes, rate: int = SAMPLE_RATE, packet_bytes: int = PACKET_BYTES, serials: tuple[int, int] = (1, 2)) -> bytes:
    """An Ogg file of ``payload`` (8-bit samples), its packets dealt in turn over two logical streams.

    Each stream opens with a header packet (magic, rate, length). A granule position counts the samples of the whole
    payload up to the end of the last packet that ends on the page, or is -1 when none does.
    """
    header = MAGIC + struct.pack("<IQ", rate, len(payload))
    out = [_page(FIRST, 0, s, 0, bytes([len(header)]), header) for s in serials]
    queues = []
    for k, serial in enumerate(serials):
        lacing, body, pages, granule, flags, number = bytearray(), bytearray(), [], -1, 0, 1
        for at in range(k * packet_bytes, len(payload), packet_bytes * len(serials)):
            packet = payload[at : at + packet_bytes]
            values = [255] * (len(packet) // 255) + [len(packet) % 255]
            done = 0
            for j, value in enumerate(values):
                if len(lacing) == 255:
                    pages.append((flags, granule, number, bytes(lacing), bytes(body)))
                    number, flags, granule = number + 1, CONTINUED if j else 0, -1
                    lacing.clear()
                    body.clear()
                lacing.append(value)
                body += packet[done : done + value]
                done += value
            granule = at + len(packet)
        pages.append((flags | LAST, granule if lacing else 0, number, bytes(lacing), bytes(body)))
        queues.append((serial, pages))
    for step in range(max(len(pages) for _, pages in queues)):
        for serial, pages in queues:
            if step < len(pages):
                flags, granule, number, lacing, body = pages[step]
                out.append(_page(flags, granule, serial, number, lacing, body))
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: its packets, and the granule position of each page with the packets ended by then."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    next_number: int = 0
    ended: bool = False
    partial: bytearray | None = None


def demux(media: bytes) -> dict[int, Stream]:
    """The logical streams of an Ogg file; raises OggError on a wrong checksum, a gap or a torn packet."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise OggError("the file ends inside a page header")
        magic, version, flags, granule, serial, number, checksum, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError("the file ends inside a page")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != checksum:
            raise OggError(f"wrong checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or number != s.next_number:
            raise OggError(f"page {number} of stream {serial} is out of order")
        if bool(flags & CONTINUED) != (s.partial is not None):
            raise OggError("a packet is torn between pages")
        body, whole = at + 27 + n, len(s.packets)
        for value in lacing:
            s.partial = bytearray() if s.partial is None else s.partial
            s.partial += media[body : body + value]
            body += value
            if value < 255:
                s.packets.append(bytes(s.partial))
                s.partial = None
        if (granule == -1) != (len(s.packets) == whole and n > 0):
            raise OggError("a granule position doesn't fit the packets that end on its page")
        s.marks.append((granule, len(s.packets)))
        s.pages, s.next_number, s.ended, at = s.pages + 1, number + 1, bool(flags & LAST), end
    if any(s.partial is not None or not s.ended for s in streams.values()):
        raise OggError("a stream doesn't end")
    return streams


def read_back(media: bytes) -> tuple[bytes, dict]:
    """Payload and features of a file that ``mux`` wrote; granule positions give timestamps and the packets' order."""
    streams = [s for _, s in sorted(demux(media).items())]
    if not streams or any(not s.packets or not s.packets[0].startswith(MAGIC) for s in streams):
        raise OggError("a header packet is missing")
    rate, length = struct.unpack_from("<IQ", streams[0].packets[0], len(MAGIC))
    queues = [s.packets[1:] for s in streams]
    payload = b"".join(q[i] for i in range(max(map(len, queues), default=0)) for q in queues if i < len(q))
    last = max(g for s in streams for g, _ in s.marks)
    if len(payload) != length or last != length:
        raise OggError("payload and granule positions disagree")
    return payload, {
        "rate": rate, "streams": len(streams), "pages": sum(s.pages for s in streams), "packets": sum(map(len, queues)),
        "last_granule": last, "duration_ms": last * 1000 // rate, "stamps_ms": [[g * 1000 // rate for g, _ in s.marks if g >= 0] for s in streams],
    }


def describe(data: bytes) -> tuple:
    """What the query returns of one text's UTF-8 bytes."""
    payload = data + b" " * (-len(data) % PAYLOAD_UNIT or PAYLOAD_UNIT * (not data))
    media = mux(payload)
    back, facts = read_back(media)
    mean = float(np.frombuffer(back, np.uint8).mean())
    feature = f"streams={facts['streams']};pages={facts['pages']};packets={facts['packets']};last_granule={facts['last_granule']};duration_ms={facts['duration_ms']};mean={mean:.4f}"
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame) -> DataFrame:
    """One row per document with the digests of its stored and reread payload.

    Null and empty texts are one unit of spaces. Other columns of ``docs`` are not read, so their names can't clash.
    Repeated rows give repeated results; no rows, none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            raw = buf.tobytes()
            cols = list(zip(*(describe(raw[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)), strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(released(run), _SCHEMA)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
