"""Operator 8: media columns. Netpbm and BMP files in a binary column are decoded to numpy arrays, area-resized by integral images and written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Samples in a row of the images that texts are stored as.
WIDTH = 64
#: Texts and images of one batch handed on, in bytes.
SLICE = 2_000_000


def encode_pgm(a: np.ndarray) -> bytes:
    """Binary greymap of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def encode_ppm(a: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """24-bit BMP, rows from the bottom, padded to 4 bytes."""
    h, w = a.shape[:2]
    row = (3 * w + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : 3 * w] = (np.repeat(a[:, :, None], 3, 2) if a.ndim == 2 else a[:, :, ::-1]).reshape(h, 3 * w)[::-1]
    return struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


HEAD = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)")
NUMBER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, plain and binary, to [rows, columns] or [rows, columns, 3]; samples above 255 as 16 bits, bitmaps as 0 and 255."""
    kind = int(data[1:2])
    at, head = 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = NUMBER.match(data, at)
        if not m:
            raise ValueError("Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h, most = (*head, 1)[:3]
    if w * h > 8 * len(data) or most > 65535:
        raise ValueError("more samples than bytes can hold")
    n, shape = (3, (h, w, 3)) if kind in (3, 6) else (1, (h, w))
    if kind in (1, 2, 3):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        a = np.frombuffer(re.sub(rb"\s", b"", body), np.uint8)[: h * w] - 48 if kind == 1 else np.array(body.split()[: h * w * n], np.int64)
        a = a.astype(np.uint16 if most > 255 else np.uint8)
    elif kind == 4:
        a = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1), axis=1)[:, :w]
    else:
        a = np.frombuffer(data, ">u2" if most > 255 else np.uint8, h * w * n, at + 1)
    return ((1 - a) * 255).astype(np.uint8).reshape(shape) if kind in (1, 4) else a.reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits, to [rows, columns, 3]."""
    start, size = struct.unpack_from("<II", data, 10)
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (8, 24, 32) or w <= 0 or abs(h) * w > len(data):
        raise ValueError("BMP kind")
    row = (w * bits // 8 + 3) // 4 * 4
    a = np.frombuffer(data, np.uint8, abs(h) * row, start).reshape(abs(h), row)[:, : w * bits // 8]
    if h > 0:
        a = a[::-1]
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)
        return colours[a][:, :, 2::-1]
    return a.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes | None) -> np.ndarray | None:
    """The image, or None where the bytes are null or no image of these kinds."""
    try:
        if data and HEAD.match(data):
            return decode_netpbm(data)
        if data and data[:2] == b"BM":
            return decode_bmp(data)
    except (ValueError, OverflowError, struct.error, IndexError):
        pass
    return None


def resize(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean over each cell of a rows x columns grid, cells weighted by area, from the integral image."""
    if not a.size:
        return np.zeros((rows, columns, *a.shape[2:]))
    for axis, n in ((0, rows), (1, columns)):
        s = np.concatenate([np.zeros_like(a[:1], np.float64), np.cumsum(a, 0, np.float64)]) if axis == 0 else np.concatenate([np.zeros_like(a[:, :1], np.float64), np.cumsum(a, 1, np.float64)], 1)
        m = s.shape[axis] - 1
        edge = np.arange(n + 1) * m / n
        low = np.minimum(edge.astype(int), m)
        part = (edge - low).reshape(-1, *[1] * (a.ndim - 1 - axis)) if axis == 0 else (edge - low).reshape(1, -1, *[1] * (a.ndim - 2))
        at = s.take(low, axis) * (1 - part) + s.take(np.minimum(low + 1, m), axis) * part
        a = np.diff(at, axis=axis) * n / m
    return a


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else a @ np.array([0.299, 0.587, 0.114])


def difference_hash(a: np.ndarray) -> str:
    """64 bits, as 16 hex digits: whether each cell of an 8 x 9 thumbnail is darker than its right neighbour."""
    small = np.round(resize(grey(a), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tile(a: np.ndarray, rows: int, columns: int) -> bytes:
    """An NPY file of the image resized to 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(resize(a, rows, columns)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and those with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def text_media(docs: DataFrame) -> DataFrame:
    """Store each text losslessly as a greymap of 64 columns: (doc_id, n_bytes, media). A null text is stored as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n, media = [], []
                for t in part.column("text"):
                    size, body = payload(t.as_py())
                    n.append(size)
                    media.append(encode_pgm(np.frombuffer(body, np.uint8).reshape(-1, WIDTH)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def image_tiles(images: DataFrame, key: str, media: str = "media", rows: int = 32, columns: int = 32) -> DataFrame:
    """Decode a media column: (key, height, width, tile, dhash). Bytes that are no image of these kinds, and nulls, give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media, SLICE):
                got = [decode(x.as_py()) for x in part.column(media)]
                cols = [[None if a is None else f(a) for a in got] for f in (lambda a: a.shape[0], lambda a: a.shape[1], lambda a: tile(a, rows, columns), difference_hash)]
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.string())))], [key, "height", "width", "tile", "dhash"])

    return images.select(key, media).mapInArrow(run, f"{key} {images.schema[key].dataType.simpleString()}, height int, width int, tile binary, dhash string")


def media_features(stored: DataFrame) -> DataFrame:
    """Read stored images back, digest them and make their tiles, one row each: (doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, tile). The feature is the difference hash, the tile an NPY file.

    Null media give nulls in all but the first two; bytes that are no image of these kinds give their own size and digest, and
    nulls in the rest. Repeated rows are worked off each; an empty table gives an empty one; no other column is looked at.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", SLICE):
                rows = []
                for x in part.column("media"):
                    m = x.as_py()
                    a = decode(m)
                    own = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
                    if a is None:
                        rows.append((None, None, None, *own, None, None))
                    else:
                        body = a.tobytes()
                        rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-WIDTH:]), *own, difference_hash(a), tile(a, 32, 32)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(list(c), t) for c, t in zip(zip(*rows), kinds))], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
