"""Ogg round trips, checksums and damage."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import media as M


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("n", [0, 1, 255, 5000])
def test_checksum(n):
    data = random.Random(n).randbytes(n)
    assert M.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 255, 510, 12_000, 24_000, 300_001])
def test_round_trip(n):
    payload = M.padded(random.Random(n).randbytes(n))
    audio = M.read_ogg(M.write_ogg(payload))
    assert audio.payload == payload and len(payload) % 64 == 0 and len(payload) >= 64
    assert [t[-1] for t in audio.times] == [len(payload) / 2 / M.RATE] * 2


@pytest.mark.parametrize("size", [255, 510, 6000 * 2, 255 * 64])
def test_packet_on_a_lacing_edge(size):
    payload = random.Random(size).randbytes(size * 2)
    assert M.read_ogg(M.write_ogg(payload)).payload == payload


def test_layout():
    stored = M.write_ogg(M.padded(b"x" * 50_000))
    pages, at = [], 0
    while at < len(stored):
        magic, version, kind, granule, serial, number, _, n = struct.unpack_from("<4sBBqIIIB", stored, at)
        size = 27 + n + sum(stored[at + 27 : at + 27 + n])
        pages.append((kind, granule, serial, number))
        assert magic == b"OggS" and version == 0
        at += size
    serials = {p[2] for p in pages}
    assert len(serials) == 2 and all(p[0] == 2 for p in pages[:2])
    for s in serials:
        own = [p for p in pages if p[2] == s]
        assert [p[3] for p in own] == list(range(len(own))) and own[-1][0] & 4
        granules = [p[1] for p in own if p[1] >= 0]
        assert granules == sorted(granules) and granules[-1] == len(M.padded(b"x" * 50_000)) // 2


def test_damage_is_found():
    stored = M.write_ogg(M.padded(b"some text " * 3000))
    rng = random.Random(1)
    for _ in range(60):
        broken = bytearray(stored)
        broken[rng.randrange(len(broken))] ^= 1 << rng.randrange(8)
        with pytest.raises(M.OggError):
            M.read_ogg(bytes(broken))
    for cut in (10, len(stored) // 2, len(stored) - 1):
        with pytest.raises(M.OggError):
            M.read_ogg(stored[:cut])
    streams, damaged = M.read_streams(b"junk" + stored)
    assert damaged == 1 and len(streams) == 2
    with pytest.raises(M.OggError):
        M.read_ogg(b"")


def test_query_columns(spark):
    texts = [None, "", "é" * 100, "x" * 64, "long " * 60_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "x" * 64), (None, "")], "doc_id long, text string").withColumn("feature", F.lit("clash"))
    rows = M.ogg_media(docs, media=True).collect()
    assert len(rows) == 7
    for r in rows:
        raw = ((texts[r.doc_id] if r.doc_id is not None else "") or "").encode()
        payload = M.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest()) and M.read_ogg(bytes(r.media)).payload == payload
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id == 3}) == 1
    assert M.ogg_media(docs.limit(0)).count() == 0
