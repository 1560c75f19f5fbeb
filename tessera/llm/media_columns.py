"""Media columns: Netpbm and BMP images to numpy arrays, thumbnails by integral images, NPY tiles, difference hashes.

Supported forms: P1 to P6 of Netpbm (plain and raw, 8 and 16 bits a sample, comments),
and uncompressed BMP with 1, 4, 8, 24 or 32 bits a pixel, bottom-up or top-down.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.batches import per_text
from tessera.llm.shared import documents, table

#: A text is stored as a grey image of this width.
WIDTH = 64
#: A tile's height and width: nine columns give eight differences.
TILE = (8, 9)

_SPACE = rb"(?:[ \t\n\r\x0b\f]|#[^\n]*\n)+"
_PNM = {n: re.compile(rb"P%d%s(\d+)%s(\d+)" % (n, _SPACE, _SPACE) + (b"" if n in (1, 4) else rb"%s(\d+)" % _SPACE) + rb"[ \t\n\r\x0b\f]") for n in range(1, 7)}


class MediaError(ValueError):
    """The bytes are not an image of a supported form."""


def decode(data: bytes) -> np.ndarray:
    """The samples of an image: height x width for one channel, height x width x 3 for colours."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data, int(data[1:2]))
    if data[:2] == b"BM":
        return _bmp(data)
    raise MediaError("neither Netpbm nor BMP")


def _netpbm(data: bytes, form: int) -> np.ndarray:
    if not (head := _PNM[form].match(data)):
        raise MediaError("no Netpbm header")
    width, height, *more = (int(x) for x in head.groups())
    most = more[0] if more else 1
    if not 0 < most < 65536:
        raise MediaError("the largest sample is out of range")
    channels = 3 if form in (3, 6) else 1
    n, body = width * height * channels, data[head.end() :]
    if form == 4:
        row = (width + 7) // 8
        if len(body) < row * height:
            raise MediaError("samples are missing")
        out = 1 - np.unpackbits(np.frombuffer(body, np.uint8, row * height).reshape(height, row), axis=1)[:, :width]
    elif form in (5, 6):
        kind = np.dtype(np.uint8) if most < 256 else np.dtype(">u2")
        if len(body) < n * kind.itemsize:
            raise MediaError("samples are missing")
        out = np.frombuffer(body, kind, n)
    elif form == 1:
        out = 1 - (np.frombuffer(re.sub(rb"[^01]", b"", re.sub(rb"#[^\n]*", b"", body)), np.uint8)[:n] - 48)
    else:
        out = np.array(re.sub(rb"#[^\n]*", b"", body).split()[:n], dtype=np.int64)
    if out.size < n:
        raise MediaError("samples are missing")
    out = out.astype(np.uint8 if most < 256 else np.uint16, copy=False)
    return out.reshape((height, width, 3) if channels == 3 else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise MediaError("no BMP header")
    start, size, width, height, _, bits, packing, _, _, _, used = struct.unpack_from("<I I i i H H I I i i I", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise MediaError("a form of BMP that is not supported")
    rows, row = abs(height), (width * bits + 31) // 32 * 4
    if len(data) < start + rows * row:
        raise MediaError("samples are missing")
    lines = np.frombuffer(data, np.uint8, rows * row, start).reshape(rows, row)
    lines = lines[::-1] if height > 0 else lines
    if bits >= 24:
        return np.ascontiguousarray(lines[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    if bits == 8:
        index = lines[:, :width]
    elif bits == 4:
        index = np.stack([lines >> 4, lines & 15], axis=2).reshape(rows, -1)[:, :width]
    else:
        index = np.unpackbits(lines, axis=1)[:, :width]
    n = used or 1 << bits
    colours = np.zeros((256, 4), np.uint8)
    colours[:n] = np.frombuffer(data, np.uint8, 4 * n, 14 + size).reshape(n, 4)
    shades = colours[:, 2::-1]
    if (shades == shades[:, :1]).all():
        return shades[index, 0]
    return shades[index]


def encode_pgm(samples: np.ndarray) -> bytes:
    """Raw 8-bit PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """Brightness as whole numbers (299, 587 and 114 thousandths of red, green and blue)."""
    return image.astype(np.int64) if image.ndim == 2 else (image.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, rounded half up, from an integral image; exact in whole numbers.

    The integral is read at fractional places by weights of 1 / ``height`` and
    1 / ``width``, so boxes may cut samples, and images may also grow.
    """
    h, w = image.shape
    sums = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(image, axis=0, dtype=np.int64, out=sums[1:, 1:])
    np.cumsum(sums[1:, 1:], axis=1, out=sums[1:, 1:])

    def at(sums: np.ndarray, n: int, parts: int) -> np.ndarray:
        place = np.arange(parts + 1) * n
        low, rest = place // parts, (place % parts)[:, None]
        return sums[low] * (parts - rest) + sums[np.minimum(low + 1, n)] * rest

    edges = at(at(sums, h, height).T.copy(), w, width).T
    boxes = edges[1:, 1:] - edges[:-1, 1:] - edges[1:, :-1] + edges[:-1, :-1]
    return (2 * boxes + h * w) // (2 * h * w)


def difference_hash(tile: np.ndarray) -> str:
    """A bit for each neighbouring pair of a row (left darker than right), as hexadecimal digits."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def tile_of(image: np.ndarray) -> np.ndarray:
    return resize(grey(image), *TILE).astype(np.uint8 if image.dtype == np.uint8 else np.uint16)


def store(text: str) -> tuple[bytes, int]:
    """The image of a text's UTF-8 bytes, padded with zeros to a positive multiple of WIDTH, and their number."""
    data = text.encode("utf-8", "replace")
    padded = data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))
    return encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)), len(data)


def features(text: str) -> tuple:
    media, n = store(text)
    image = decode(media)
    payload = image.tobytes()
    tile = tile_of(image)
    kept = np.load(io.BytesIO(npy(tile)), allow_pickle=False)
    return (
        n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media),
        hashlib.sha256(media).hexdigest(), f"dhash:{difference_hash(kept)}",
    )


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, media (PGM) and tile (NPY) of each document's text; null texts are empty."""

    def row(text: str) -> tuple[bytes, bytes]:
        media, _ = store(text)
        return media, npy(tile_of(decode(media)))

    return per_text(documents(docs), row, "media binary, tile binary")


def tiles(images: DataFrame, key: str = "page_id", media: str = "media") -> DataFrame:
    """``key``, height, width, tile (NPY) and dhash of each image; all null but ``key`` where bytes are null or no image."""
    import pyarrow as pa

    kind = images.schema[key].dataType.simpleString()

    def one(data: bytes | None) -> tuple:
        try:
            image = decode(data or b"")
            tile = tile_of(image)
        except (MediaError, ValueError, IndexError):
            return None, None, None, None
        return image.shape[0], image.shape[1], npy(tile), difference_hash(tile)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = list(zip(*map(one, batch.column(1).to_pylist())))
                arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, "height", "width", "tile", "dhash"])

    return images.select(key, media).mapInArrow(run, f"{key} {kind}, height int, width int, tile binary, dhash string")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The stored form of every document. Null and empty texts are 64 bytes 0; equal texts have equal values; very long texts are whole. Extra columns are not read. No rows for no documents."""
    return per_text(documents(table(spark, folder, "documents")), features, SCHEMA)
