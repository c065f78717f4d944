"""Media columns: an Ogg container written and read in plain bytes.

A payload of 8-bit samples is stored as one logical stream for each channel (sample i belongs to channel i mod 2). A
stream starts with a header packet (magic, rate, channel, channels) on a page of its own; data packets follow, laced into
segments of at most 255 bytes and continued across pages. The granule position of a page counts the stream's samples up
to the end of the last packet that ends on it. Reading verifies each page's checksum, reassembles packets from lacing
values, separates the streams by serial number and derives times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text

MAGIC = b"\x80pcm8\0\1\0"
RATE = 8000
CHANNELS = 2
PACKET = 6000
PAGE_SEGMENTS = 64
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


class OggError(ValueError):
    """A file that breaks the container's rules."""


def page_crc(page: bytes) -> int:
    """The container's checksum: polynomial 04c11db7, most significant bit first, from 0, not inverted.

    It is the usual CRC-32 (least significant bit first) of the bytes with their bits mirrored.
    """
    low = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "big").translate(_MIRROR), "little")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]


def _stream(packets: list[bytes], ends: list[int], serial: int) -> list[tuple[int, bytes]]:
    """Pages of one stream with the sample at which each begins."""
    out = [(-1, _page(2, 0, serial, 0, bytes([len(packets[0])]), packets[0]))]
    lacing, body, granule, cont, begin = bytearray(), [], -1, False, 0

    def flush(more: bool, last: bool) -> None:
        nonlocal lacing, body, granule, cont, begin
        out.append((begin, _page((1 if cont else 0) | (4 if last else 0), granule, serial, len(out), bytes(lacing), b"".join(body))))
        begin = granule if granule >= 0 else begin
        lacing, body, granule, cont = bytearray(), [], -1, more

    for k, (packet, end) in enumerate(zip(packets[1:], ends, strict=True)):
        at, left = 0, len(packet) // 255 + 1
        while left:
            n = min(left, PAGE_SEGMENTS - len(lacing))
            if not n:
                flush(at > 0, False)
                continue
            done = n == left
            size = min(len(packet) - at, 255 * n)
            lacing += b"\xff" * (n - 1) + bytes([len(packet) - at - 255 * (n - 1) if done else 255])
            body.append(packet[at : at + size])
            at, left = at + size, left - n
        granule = end
        if k == len(ends) - 1:
            flush(False, True)
    return out


def write_ogg(payload: bytes, rate: int = RATE, channels: int = CHANNELS) -> bytes:
    """Store 8-bit samples; the serial numbers follow from the payload, so equal payloads give equal files."""
    base = zlib.crc32(payload)
    pages = []
    for c in range(channels):
        samples = payload[c::channels]
        packets = [MAGIC + struct.pack("<IBB", rate, c, channels)] + [samples[i : i + PACKET] for i in range(0, len(samples), PACKET)]
        ends = [min(i + PACKET, len(samples)) for i in range(0, len(samples), PACKET)]
        pages += [(begin, c, n, page) for n, (begin, page) in enumerate(_stream(packets, ends, (base + c) & 0xFFFFFFFF))]
    pages.sort(key=lambda x: x[:3])
    return b"".join(x[3] for x in pages)


@dataclass
class Stream:
    """One logical stream as read: packets, the granule position known for each (-1: none), and its pages."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    number: int = -1
    ended: bool = False
    part: list[bytes] = field(default_factory=list)
    lost: int = 0


def read_streams(data: bytes) -> tuple[dict[int, Stream], int]:
    """(streams by serial number in order of their first page, damaged pages). A damaged page is left out; reading goes on at the next page mark."""
    streams: dict[int, Stream] = {}
    at, damaged = 0, 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or len(data) - at < 27:
            damaged += 1
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, version, kind, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        begin = at + 27 + n
        end = begin + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < n or len(data) < end or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            damaged += 1
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        s = streams.setdefault(serial, Stream())
        if number != s.number + 1 or not kind & 1:
            s.lost += bool(s.part)
            s.part = []
        skip = bool(kind & 1) and (number != s.number + 1 or not s.part and not s.pages)  # the rest of a packet whose start is lost
        s.number, s.pages, s.ended = number, s.pages + 1, bool(kind & 4)
        size, first = 0, len(s.packets)
        for value in lacing:
            size += value
            if value < 255:
                s.part.append(data[begin : begin + size])
                begin, size = begin + size, 0
                if skip:
                    s.lost, skip = s.lost + 1, False
                else:
                    s.packets.append(b"".join(s.part))
                    s.granules.append(-1)
                s.part = []
        if size and not skip:
            s.part.append(data[begin : begin + size])
        if granule >= 0 and len(s.packets) > first:
            s.granules[-1] = granule
        at = end
    return streams, damaged


@dataclass
class Audio:
    """What a file holds: samples of all channels, the time at which each data packet ends, and counts."""

    payload: bytes
    rate: int
    times: list[list[float]]
    pages: int
    packets: int
    damaged: int


def read_ogg(data: bytes) -> Audio:
    """Read a file back; a damaged, cut or inconsistent file raises OggError."""
    streams, damaged = read_streams(data)
    parts: dict[int, bytes] = {}
    times: dict[int, list[float]] = {}
    rate = channels = 0
    for s in streams.values():
        if not s.packets or not s.packets[0].startswith(MAGIC):
            raise OggError("a stream has no header packet")
        rate, c, channels = struct.unpack("<IBB", s.packets[0][len(MAGIC) :])
        # A packet's time: from the next known granule position, less the samples of the packets after it.
        ends, known = [], -1
        for packet, granule, after in zip(s.packets[:0:-1], s.granules[:0:-1], [b"", *s.packets[:1:-1]], strict=False):
            known = granule if granule >= 0 else known - len(after) if known >= 0 else -1
            ends.append(known)
        ends.reverse()
        total = 0
        for packet, end in zip(s.packets[1:], ends, strict=True):
            total += len(packet)
            if end != total:
                raise OggError("granule positions do not follow the samples")
        if not s.ended or s.lost:
            raise OggError("a stream is cut")
        parts[c], times[c] = b"".join(s.packets[1:]), [e / rate for e in ends]
    if damaged or not parts or sorted(parts) != list(range(channels)):
        raise OggError("pages or channels are missing")
    payload = bytearray(sum(map(len, parts.values())))
    for c, x in parts.items():
        payload[c::channels] = x
    return Audio(bytes(payload), rate, [times[c] for c in range(channels)], sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values()), damaged)


def features(audio: Audio) -> str:
    """Container and signal features in a fixed order."""
    x = np.frombuffer(audio.payload, np.uint8)
    n = len(x)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    seconds = max(t[-1] for t in audio.times)
    return f"streams={len(audio.times)};pages={audio.pages};packets={audio.packets};rate={audio.rate};seconds={seconds:.6f};mean={total / n:.6f};rms={(squares / n) ** 0.5:.6f};peak={int(x.max())};crossings={crossings}"


def padded(text: bytes) -> bytes:
    """Bytes with zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def ogg_media(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), media: bool = False) -> DataFrame:
    """Store each row's ``text`` as samples in an Ogg file, read the file back and describe it.

    Adds n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of what was read back), media_bytes, media_sha256,
    feature and, with ``media``, the file. A null or empty text is 64 zero bytes. Equal texts give equal files; repeated
    rows stay repeated; an empty table gives an empty result; columns other than ``keep`` are ignored. No shuffle; a
    worker holds about a megabyte of texts and their files, or one longer text, at a time.
    """

    def work(texts: list[bytes]) -> dict[str, list]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
        out: dict[str, list] = {k: [] for k in names}
        for text in texts:
            stored = write_ogg(padded(text))
            audio = read_ogg(stored)
            got = audio.payload
            row = (len(text), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(audio), stored)
            for k, v in zip(names, row, strict=True):
                out[k].append(v)
        return out

    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    ddl = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if media:
        fields.append(("media", pa.binary()))
        ddl += ", media binary"
    return per_text(docs, list(keep), lambda: work, fields, ddl)
