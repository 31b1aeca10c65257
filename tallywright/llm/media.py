"""Media columns: bytes as PNG pictures in a binary column, read back with checks, and perceptual hashes of them."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm._words import blocks, give_back

WIDTH = 64
_SIGN = b"\x89PNG\r\n\x1a\n"
_SIDE, _LOW = 32, 8
_COS = np.cos(np.pi / _SIDE * np.outer(np.arange(_LOW), np.arange(_SIDE) + 0.5))


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, zeros appended up to a positive multiple of WIDTH."""
    raw = text.encode() if text else b""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A grey 8-bit picture of 2-D samples; each row takes the filter None, Sub or Up of the least absolute sum."""
    rows = np.ascontiguousarray(samples, np.uint8)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    tried = np.stack([rows, sub, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tried[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", rows.shape[1], len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the row filters of 8-bit grey lines (None, Sub, Up, Average, Paeth)."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    at = kinds == 1
    out[at] = np.cumsum(out[at], axis=1, dtype=np.uint8)
    if not (kinds >= 2).any():
        return out
    if not (kinds >= 3).any():
        # Runs of Up rows are running sums down from the row above each run.
        first = np.flatnonzero(kinds != 2)
        if not len(first) or first[0]:
            first = np.concatenate(([0], first))
        total = np.cumsum(out, axis=0, dtype=np.uint8)
        base = np.zeros((len(first), out.shape[1]), np.uint8)
        base[first > 0] = total[first[first > 0] - 1]
        return total - np.repeat(base, np.diff(np.append(first, len(out))), axis=0)
    above = np.zeros(out.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        row = out[y]
        if kind == 2:
            row += above
        elif kind == 3:
            left = 0
            for x in range(len(row)):
                row[x] = left = (int(row[x]) + ((left + int(above[x])) >> 1)) & 255
        elif kind == 4:
            a = c = 0
            for x in range(len(row)):
                b = int(above[x])
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                row[x] = a = (int(row[x]) + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
                c = b
        above = row
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit picture; a wrong signature, length or checksum raises ValueError."""
    if data[:8] != _SIGN:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("PNG chunk cut short")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of PNG chunk {kind!r} differs")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended |= kind == b"IEND"
        at += 12 + size
    if not head or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(lines) != head[1] * (head[0] + 1):
        raise ValueError("PNG data of another size")
    return _unfilter(lines.reshape(head[1], head[0] + 1))


def _shrink(x: np.ndarray, size: int) -> np.ndarray:
    """Means over `size` even shares of the first axis, whole numbers and parts of rows alike."""
    edges = np.linspace(0, len(x), size + 1)
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    low = np.minimum(edges.astype(int), len(x) - 1)
    at = total[low] + (edges - low)[:, None] * x[low]
    return np.diff(at, axis=0) / (len(x) / size)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: of the 8 x 8 lowest cosine frequencies of the picture at 32 x 32, those over their median."""
    small = _shrink(_shrink(samples.astype(np.float64), _SIDE).T, _SIDE).T
    low = np.round(_COS @ small @ _COS.T, 6)
    bits = low > np.median(low.ravel()[1:])
    return np.packbits(bits).tobytes().hex()


def media_column(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every text's payload as a PNG of 64 samples a row.

    A null or empty text is a row of zeros. Keys of any type, null or repeated,
    pass through as they are; every row stays, other columns are left out
    whatever their names, and an empty table gives none. A task turns about a
    million characters into pictures at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, texts in blocks(batches):
            media = [encode_png(np.frombuffer(payload_of(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
            size = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, size, pa.array(media, pa.binary())], ["key", "n_bytes", "media"])
        give_back()

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *_MEDIA.fields])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


_MEDIA = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
_FEATURES = T.StructType(
    [
        *[T.StructField(c, T.LongType() if c in ("payload_bytes", "tail_crc32", "media_bytes") else T.StringType())
          for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")],
    ]
)


def media_features(media: DataFrame, key: str) -> DataFrame:
    """Of (key, n_bytes, media), from the stored bytes: sizes and digests of payload and picture, and feature, the cosine hash.

    Pictures are read one after another; one that is damaged or null raises.
    Keys pass through as they are, repeated rows stay, other columns are left
    out, and an empty table gives none.
    """

    def features(stored: bytes) -> tuple:
        samples = decode_png(stored)
        data = samples.tobytes()
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [features(x.as_buffer().to_pybytes()) for x in batch.column("media")]
                yield pa.RecordBatch.from_arrays([*batch.select(["key", "n_bytes"]).columns, *[pa.array(c) for c in zip(*rows, strict=True)]], ["key", "n_bytes", *_FEATURES.names])
        give_back()

    rows = media.select(F.col(f"`{key}`").alias("key"), "n_bytes", "media")
    schema = T.StructType([*rows.select("key", "n_bytes").schema.fields, *_FEATURES.fields])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
