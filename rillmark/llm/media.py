"""Media columns: PNG in binary columns, and low-frequency cosine-transform hashes.

`to_png` stores 8-bit grey samples; rows get the filter (none, left, above) with the least sum of signed
differences; the zlib stream is cut into IDAT chunks. `from_png` checks the signature, every chunk's
CRC-32, the stream's own checksum and its length, and undoes all five filters with array operations
(left: running sums along rows; above: row by row; average and Paeth: column by column within a row).
`cosine_hash` is 64 bits: the 8 by 8 lowest cosine coefficients, each against their median.

Nothing is shuffled. A null text is an empty one: 192 blanks. Equal texts give equal values; repeated
rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.util import pieces

WIDTH, CHUNK, SIGNATURE = 192, 1 << 16, b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(image: np.ndarray) -> np.ndarray:
    """The rows with their filter's number before them."""
    left = image.copy()
    left[:, 1:] -= image[:, :-1]
    above = image.copy()
    above[1:] -= image[:-1]
    options = np.stack([image, left, above])
    best = np.abs(options.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    out = np.empty((image.shape[0], image.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = options[best, np.arange(len(best))]
    return out


def to_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    stream = zlib.compress(filtered(image).tobytes(), level)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)) + b"".join(_chunk(b"IDAT", stream[i : i + CHUNK]) for i in range(0, len(stream), CHUNK)) + _chunk(b"IEND", b"")


def unfiltered(rows: np.ndarray) -> np.ndarray:
    kind, out = rows[:, 0], rows[:, 1:].copy()
    if (kind > 4).any():
        raise ValueError("unknown filter")
    side = kind == 1
    out[side] = np.cumsum(out[side], axis=1, dtype=np.uint8)
    zero = np.zeros(out.shape[1], np.uint8)
    for y in np.flatnonzero(kind > 1).tolist():
        up = out[y - 1] if y else zero
        if kind[y] == 2:
            out[y] += up
            continue
        row, a, c = out[y], 0, 0
        for x, b in enumerate(up.tolist()):
            if kind[y] == 3:
                a = (int(row[x]) + (a + b) // 2) & 255
            else:
                pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                a = (int(row[x]) + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
            row[x], c = a, b
    return out


def from_png(data: bytes) -> np.ndarray:
    """The image of an 8-bit grey PNG; ValueError if any checksum or length is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, stream, head, ended = 8, [], None, False
    while at + 12 <= len(data) and not ended:
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey image")
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8).reshape(head[1], head[0] + 1)
    except (zlib.error, ValueError) as e:
        raise ValueError("the samples are damaged") from e
    return unfiltered(rows)


@lru_cache(512)
def _basis(n: int) -> np.ndarray:
    return (np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(8)[:, None] / (2 * n)) * np.sqrt(2 / n)).astype(np.float32)


def cosine_hash(image: np.ndarray) -> str:
    c = (_basis(image.shape[0]) @ (image.astype(np.float32) @ _basis(image.shape[1]).T)).astype(np.float64).round(2).ravel()
    bits = c > np.median(c[1:])
    bits[0] = c[0] > 0
    return np.packbits(bits).tobytes().hex()


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH if text else WIDTH)


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a PNG."""

    def run(batches):
        for batch in pieces(batches):
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_png(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def described(media: DataFrame) -> DataFrame:
    """The columns of a media column's images: what the payload was, and its hash."""

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column(2):
                data = data.as_buffer().to_pybytes()
                image = from_png(data)
                payload = image.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
