"""Shared pieces: the shared folder, word hashing over Arrow buffers, and packed integer blobs.

Nothing here keeps state between tasks, so a lost executor's work is simply done again.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are hashed at a time; bounds the temporary arrays of `words`.
CHUNK = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may lack one; it gets a folder of its own."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not set_dir and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(set_dir or f"file://{tempfile.mkdtemp(prefix='rillmark-')}")
        current = sc._jsc.sc().getCheckpointDir()
    return set_dir or current.get()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, with its scheme. It is deleted when the driver's JVM ends."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = path.getFileSystem(conf)
    own = jvm.org.apache.hadoop.fs.Path(f"{files.makeQualified(path).toString().rstrip('/')}/{what}-{uuid.uuid4().hex}")
    files.mkdirs(own)  # what isn't there can't be marked
    files.deleteOnExit(own)
    return own.toString()


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a table from `written` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f.rpartition("/")[0])
        path.getFileSystem(conf).delete(path, True)


#: Shares into which the rows of one key are dealt.
SALTS = 32


def salted(df: DataFrame, *spread: str) -> DataFrame:
    """``df`` with ``_salt``, by a hash of columns that differ within a key."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with the one row that ``right`` has of each key, where a key may hold a third of ``left``.

    A key's rows are dealt over SALTS tasks by the columns ``spread``; a row of ``right`` is copied only for the
    shares that ``left`` has, so a table of distinct keys isn't multiplied. ``left`` is read twice.
    """
    dealt = salted(left, *spread)
    asked = dealt.select(*keys, "_salt").distinct().join(right, keys)
    return dealt.join(asked, [*keys, "_salt"], how).drop("_salt")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64), so that every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Words of more bytes than this are hashed and compared as a whole instead of by 8 bytes at a time.
LONG = 512


def _lanes(data: np.ndarray) -> np.ndarray:
    """For each place of ``data`` and the one behind it: the 8 bytes from there on as a number (0 past the end)."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def _cut(lane: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first ``left`` bytes of each lane."""
    bits = (np.minimum(left, 8) * 8).astype(U64)
    return np.where(left < 8, lane & ((U64(1) << (bits & U64(63))) - U64(1)), lane)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: its length, then 8 bytes after 8 bytes, each mixed into what is before.

    Up to 8 bytes the hash of a length's ranges is one to one. Longer ranges have no sums or products that
    could cancel out; those over LONG bytes take BLAKE2b.
    """
    n = end - start
    h = mix(n.astype(U64) + U64(0x9E3779B97F4A7C15))
    lanes, live, at = _lanes(data), np.flatnonzero((n > 0) & (n <= LONG)), 0
    while len(live):
        left = n[live] - at
        h[live] = mix(h[live] ^ _cut(lanes[start[live] + at], left))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def same_ranges(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n bytes of ``a`` from a_at and of ``b`` from b_at are the same, for each triple."""
    same, x, y = np.ones(len(n), bool), _lanes(a), _lanes(b)
    live, at = np.flatnonzero(n > 0), 0
    while len(live) and at < LONG:
        left = n[live] - at
        differ = _cut(x[a_at[live] + at] ^ y[b_at[live] + at], left) != 0
        same[live[differ]] = False
        live, at = live[(left > 8) & ~differ], at + 8
    for i in live.tolist():
        same[i] = np.array_equal(a[a_at[i] + at : a_at[i] + n[i]], b[b_at[i] + at : b_at[i] + n[i]])
    return same


def byte_class(in_word) -> np.ndarray:
    """256 flags: whether a byte of UTF-8 belongs to a word; bytes from 128 on are asked for as 128."""
    return np.array([bool(in_word(min(b, 128))) for b in range(256)])


#: Words of letters, digits and everything that isn't ASCII (after A-Z has become a-z).
PLAIN_WORDS = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: Words between ASCII white space.
SPACED_WORDS = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (of a slice, only its own) and each row's offsets in them; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n, buffers = len(column), column.buffers()
    if not n or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if column.null_count and offsets[-1] > offsets[0]:
        empty = np.diff(offsets)[np.asarray(column.is_null())]
        if empty.any():  # the format allows bytes behind a null
            return raw(column.fill_null(""))
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a column: byte ranges in ``data``, the row of each, and a 64-bit hash of each (lower-cased)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def bounds(self) -> np.ndarray:
        """Row i has the words bounds[i]:bounds[i+1]."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def text(self, i: int) -> bytes:
        return LOWER[self.data[self.start[i] : self.end[i]]].tobytes()


def words(column: pa.Array, in_word: np.ndarray = PLAIN_WORDS, lower: bool = True, split: np.ndarray | None = None) -> Words:
    """Splits a string column into words without making Python strings.

    in_word has a class for each byte, 0 for what stands between words; where split is given, a word also
    ends between two bytes of classes x and y if split[x, y].

    Hashes are those of `range_hashes`; the work is a few array operations per byte whatever the words' lengths are.
    """
    data, offsets = raw(column)
    starts, ends, hashes = [], [], []
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        end = min(stop, at + CHUNK)
        while end < stop and in_word[data[end]]:  # never cut within a word
            tail = np.flatnonzero(in_word[data[end : min(stop, end + CHUNK)]] == 0)
            end = end + int(tail[0]) if len(tail) else min(stop, end + CHUNK)
        part = data[at:end]
        inside = in_word[part] > 0
        cuts = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end, "left")] - at
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        if split is not None:
            first[1:] |= split[in_word[part[:-1]], in_word[part[1:]]]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        last[cuts - 1] = inside[cuts - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(range_hashes(LOWER[part] if lower else part, s, e))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(data, start, join(ends, np.int64), np.searchsorted(offsets, start, "right") - 1, join(hashes, U64), len(offsets) - 1)


def release() -> None:
    """Gives memory that Arrow and the C library keep for later back to the system; workers live long."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = "4m"):
    """While it lasts, what runs hands Python Arrow batches of about ``most`` bytes; a batch exists several times, here and in the JVM."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pieces(batches, column: int = 1, most: int = 1 << 20):
    """The batches cut so that each holds about ``most`` bytes of a string column, or one longer text."""
    for batch in batches:
        release()
        _, offsets = raw(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            to = min(n, to)
            yield batch.slice(at, to - at)
            at = to
    batch = None
    release()


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes in planes (all lowest bytes first, and so on), compressed."""
    import zstandard

    values = np.ascontiguousarray(values, U64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(values).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes))


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[9:]), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(U64).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers, as differences."""
    return pack(np.diff(values, prepend=U64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=U64)
