"""Round trips and hand-made files of the media formats."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import media_columns as m

GREY = np.arange(35, dtype=np.uint8).reshape(5, 7)
COLOUR = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)


def test_netpbm_forms():
    assert (m.decode(m.encode_pgm(GREY)) == GREY).all()
    assert (m.decode(b"P2 # c\n7 5\n255\n" + " ".join(map(str, GREY.ravel())).encode()) == GREY).all()
    assert (m.decode(b"P6\n#x\n5 4\n255\n" + COLOUR.tobytes()) == COLOUR).all()
    assert (m.decode(b"P3 5 4 255\n" + " ".join(map(str, COLOUR.ravel())).encode()) == COLOUR).all()
    wide = (GREY.astype(np.uint16) * 900).astype(">u2")
    assert (m.decode(b"P5 7 5 65535\n" + wide.tobytes()) == wide).all()
    bits = GREY % 2
    assert (m.decode(b"P4 7 5\n" + np.packbits(1 - bits, axis=1).tobytes()) == bits).all()
    assert (m.decode(b"P1 7 5\n" + "".join(str(1 - b) for b in bits.ravel()).encode()) == bits).all()


def bmp(bits, rows, width, height, palette=b""):
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, 0, 0, 0, len(palette) // 4, 0) + palette + rows


def test_bmp_forms():
    line = [COLOUR[y, :, ::-1].tobytes() + b"\0" for y in range(4)]
    assert (m.decode(bmp(24, b"".join(line[::-1]), 5, 4)) == COLOUR).all()
    assert (m.decode(bmp(24, b"".join(line), 5, -4)) == COLOUR).all()
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256))
    assert (m.decode(bmp(8, b"".join(GREY[y].tobytes() + b"\0" for y in range(5)), 7, -5, palette)) == GREY).all()


@pytest.mark.parametrize("data", [b"", b"P5 2 2 255\nab", b"BMxx", b"GIF89a", b"P5 2 2 0\nabcd"])
def test_bad_media(data):
    with pytest.raises(m.MediaError):
        m.decode(data)


def test_resize_is_the_mean_of_areas():
    grown = np.kron(GREY.astype(np.int64), np.ones((8, 9), np.int64))
    exact = grown.reshape(8, 5, 9, 7).sum(axis=(1, 3))
    assert (m.resize(GREY.astype(np.int64), 8, 9) == (2 * exact + 35) // 70).all()


@pytest.mark.parametrize("text", ["", "a", "é" * 40, "x" * 64, "日本" * 5000])
def test_text_round_trip(text):
    data = text.encode()
    padded = data + bytes(-len(data) % 64 or (0 if data else 64))
    n, size, sha, tail, media_bytes, media_sha, feature = m.features(text)
    assert (n, size, sha, tail) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    media, _ = m.store(text)
    assert (len(media), hashlib.sha256(media).hexdigest()) == (media_bytes, media_sha) and m.decode(media).tobytes() == padded
    assert np.load(io.BytesIO(m.npy(m.tile_of(m.decode(media))))).shape == m.TILE and feature.startswith("dhash:")


def test_tiles_of_a_table(spark):
    rows = [(1, bytearray(m.encode_pgm(GREY))), (2, None), (3, bytearray(b"junk")), (None, bytearray(m.encode_pgm(GREY)))]
    out = m.tiles(spark.createDataFrame(rows, "page_id long, media binary")).collect()
    assert [(r["page_id"], r["height"], r["dhash"] is None) for r in out] == [(1, 5, False), (2, None, True), (3, None, True), (None, 5, False)]
