"""Token ids in sorted-string-table shards.

A shard, in order:

    "RMSST001"
    data blocks   entries, then the CRC-32 of what precedes in the block
        entry     varints: bytes shared with the key before (0 at a block's start), further key bytes, value bytes;
                  then those key bytes and the value (ids, little-endian, of the footer's width)
    index         per block: key length and last key, offset, length, entries, ids before it in the shard
    Bloom filter  K = 7 hashes, 10 bits per key
    footer        56 bytes: index offset and length, filter offset and length, entries, ids (u64 each),
                  id width (u32), CRC-32 of index and filter (u32) ... then "RMSSTEND"

Keys are the ids as 8 big-endian bytes with the sign turned, so byte order is number order; a null id is
the empty key, first. A lookup reads footer, filter and index, then one block. Equal keys are kept, side
by side.

Documents are range-partitioned by id; each task writes shards of about ``SHARD_BYTES`` to the shared
folder, first under a name of its own attempt and then renamed, so a task that runs again or twice leaves
the same files. A range goes by id, then a hash of the text, then the row's place in the input, so rows that share an id
are many tasks' too. A shard's ids before it come from running sums in two levels: over tasks, and over a task's shards.
The manifest's rows are dealt out and each task reads its shards' files block by block; nothing is broadcast.

Encoding: the tokenizer never joins what stands on both sides of white space, or of a change between
letters, digits and marks (but near quotes, ``<|>`` and non-ASCII characters, where no cut is made), so
texts are cut there without making strings and each distinct piece is encoded once per worker and batch.
Pieces are found by hash and their bytes compared before a remembered encoding is used, so ids never depend on the hash;
`tests/llm/` holds this against whole-text encoding.

A null text is an empty one: just the end id. An empty table gives no shards and no rows. Ids are whole numbers; rows that
repeat one are ordered by a hash of the text and then by the text. Other columns are not read.
"""

from __future__ import annotations

import bisect
import io
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.util import LOWER, U64, mix, pieces, raw, same_ranges, scratch, small_batches, words, written

MAGIC, TAIL = b"RMSST001", b"RMSSTEND"
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 8 << 20
BITS_PER_KEY, HASHES = 10, 7
_FOOTER = struct.Struct("<6QII8s")
MOST_CACHED = 400_000  # pieces a worker remembers

#: Byte classes: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 not ASCII, 5 never cut beside it.
_CLASS = np.array([0 if b == 32 or 9 <= b <= 13 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 5 if chr(b) in "'<|>" else 3 for b in range(128)] + [4] * 128, np.uint8)
_CUT = np.zeros((6, 6), bool)
_CUT[np.ix_([1, 2, 3], [1, 2, 3])] = True
_CUT[1, 1] = _CUT[3, 3] = False


class Encoder:
    """Texts to ids by a tokenizers file whose pre-tokenizer is that of ``word_bpe_49k.json``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        level = self.tokenizer.pre_tokenizer
        self.bytes = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x61, 0x180)) if c.isalpha() and c == c.lower() and c != "İ"}

    def _forget(self) -> None:
        """Of each remembered piece: hash (ascending), place and size of its bytes, place and number of its ids."""
        self.known, self.at, self.size, self.offset, self.count = np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(4))
        self.spelled, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def _piece_ids(self, texts: list[str]) -> list[list[int]]:
        out, rest = [None] * len(texts), []
        model, level = self.tokenizer.model, self.bytes
        for i, t in enumerate(texts):
            t = t.lower() if t.isalpha() else ""
            try:
                if not t or not unicodedata.is_normalized("NFC", t):
                    raise KeyError
                out[i] = [x.id for x in model.tokenize("".join([level[c] for c in t]))]
            except KeyError:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else (), strict=True):
            out[i] = e.ids
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, and each row's bounds in them."""
        data, offsets = raw(column)
        lower = b"<|" not in memoryview(data[offsets[0] : offsets[-1]]).tobytes()  # special tokens are told by case
        w = words(column, _CLASS, lower, _CUT)
        text, size = (LOWER[data] if lower else data), w.end - w.start
        # a piece of either kind has a hash of its own, else the two would push each other out
        h = w.hash if lower else mix(w.hash + U64(1))
        distinct, first, place = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = self.known[np.minimum(at, len(self.known) - 1)] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.known) + new.sum() > MOST_CACHED:
                new[:] = True
                self._forget()
            self._learn(text, w.start[first[new]], size[first[new]], distinct[new])
            at = np.searchsorted(self.known, distinct)
        at = at[place]
        offset, n, ids = self.offset[at], self.count[at], self.ids
        same = size == self.size[at]
        same[same] = same_ranges(text, w.start[same], self.spelled, self.at[at[same]], size[same])
        if not same.all():  # another piece has the hash: encoded by itself, not remembered
            other = np.flatnonzero(~same)
            got = self._piece_ids([text[a:b].tobytes().decode() for a, b in zip(w.start[other].tolist(), w.end[other].tolist(), strict=True)])
            n[other] = [len(x) for x in got]
            offset[other] = len(ids) + np.cumsum(n[other]) - n[other]
            ids = np.concatenate([ids, np.fromiter((y for x in got for y in x), np.uint32, int(n[other].sum()))])
        end = np.cumsum(n)
        ids = ids[np.repeat(offset - (end - n), n) + np.arange(int(n.sum()))]
        return ids, np.concatenate([[0], end])[w.bounds()]

    def _learn(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> None:
        got = self._piece_ids([text[a : a + k].tobytes().decode() for a, k in zip(start.tolist(), size.tolist(), strict=True)])
        count = np.array([len(x) for x in got], np.int64)
        offset, at = len(self.ids) + np.cumsum(count) - count, len(self.spelled) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter((y for x in got for y in x), np.uint32, int(count.sum()))])
        self.spelled = np.concatenate([self.spelled, text[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at, self.size, self.offset, self.count = (np.concatenate(x)[order] for x in ((self.at, at), (self.size, size), (self.offset, offset), (self.count, count)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, with what it has learned from earlier batches."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) % (1 << 64))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n, shift, at = n | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return n, at


def _spots(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([zlib.crc32(k) | zlib.crc32(k, 0x5BD1E995) << 32 for k in keys], U64)
    a, b = mix(h), mix(h ^ U64(0x9E3779B97F4A7C15)) | U64(1)
    return np.stack([(a + U64(i) * b) % U64(bits) for i in range(HASHES)]).astype(np.int64)


class ShardWriter:
    """Collects entries in key order; `close` gives the shard's bytes."""

    def __init__(self, width: int = 2, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = io.BytesIO(), width, block_bytes
        self.out.write(MAGIC)
        self.block, self.last, self.keys, self.index = bytearray(), b"", [], []
        self.entries = self.ids = self.block_entries = self.block_ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            for a, b in zip(key, self.last, strict=False):
                if a != b:
                    break
                shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.block_entries += 1
        self.block_ids += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            at = self.out.tell()
            self.out.write(self.block + struct.pack("<I", zlib.crc32(self.block)))
            self.index.append(struct.pack("<B", len(self.last)) + self.last + struct.pack("<4Q", at, len(self.block), self.block_entries, self.ids))
            self.entries, self.ids = self.entries + self.block_entries, self.ids + self.block_ids
            self.block, self.block_entries, self.block_ids = bytearray(), 0, 0

    def close(self) -> bytes:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        flags = np.zeros((bits + 7) // 8 * 8, np.uint8)
        if self.keys:
            flags[_spots(self.keys, bits).ravel()] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(flags, bitorder="little").tobytes()
        at = self.out.tell()
        self.out.write(index + bloom + _FOOTER.pack(at, len(index), at + len(index), len(bloom), self.entries, self.ids, self.width, zlib.crc32(index + bloom), TAIL))
        return self.out.getvalue()


class ShardReader:
    """Reads a shard from a seekable file; only footer, index and filter are held."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        file.seek(file.tell() - _FOOTER.size)
        at, n, bloom_at, bloom_n, self.entries, self.n_ids, self.width, crc, tail = _FOOTER.unpack(file.read(_FOOTER.size))
        file.seek(0)
        if tail != TAIL or file.read(8) != MAGIC:
            raise ValueError("not a shard")
        file.seek(at)
        index, bloom = file.read(n), file.read(bloom_n)
        if zlib.crc32(index + bloom) != crc:
            raise ValueError("the index is damaged")
        self.last, self.blocks, at = [], [], 0
        while at < n:
            k = index[at]
            self.last.append(index[at + 1 : at + 1 + k])
            self.blocks.append(struct.unpack_from("<4Q", index, at + 1 + k))
            at += 33 + k
        self.bits = struct.unpack_from("<Q", bloom)[0]
        self.bloom = np.frombuffer(bloom, np.uint8, offset=8)

    def _block(self, i: int):
        at, n, _, _ = self.blocks[i]
        self.file.seek(at)
        data = self.file.read(n + 4)
        if zlib.crc32(data[:n]) != struct.unpack("<I", data[n:])[0]:
            raise ValueError("a block is damaged")
        at, key = 0, b""
        while at < n:
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at + more)
            at += more + size

    def may_have(self, key: bytes) -> bool:
        spots = _spots([key], self.bits).ravel()
        return bool((self.bloom[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of this id: a binary search in the index, then one block (more if they go on)."""
        key, out = key_of(doc_id), []
        if self.may_have(key):
            for i in range(bisect.bisect_left(self.last, key), len(self.last)):
                out += [ids for k, ids in self._block(i) if k == key]
                if self.last[i] > key:
                    break
        return out

    def __iter__(self):
        """(doc_id, ids before it in the shard, ids)."""
        for i, (_, _, _, before) in enumerate(self.blocks):
            for key, ids in self._block(i):
                yield id_of(key), before, ids
                before += len(ids)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards below ``path``; returns their manifest: name, entries, ids, in key order by name."""

    def run(batches):
        import os

        import pyarrow.fs as pafs
        from pyspark import TaskContext

        context = TaskContext.get()
        files, folder = pafs.FileSystem.from_uri(path)
        enc, serial, size, writer = encoder(tokenizer), 0, 0, None
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4

        def close():
            nonlocal serial, size, writer
            name = f"part-{context.partitionId():06d}-{serial:05d}.sst"
            data = writer.close()
            own = f"{folder}/.{name}.{context.taskAttemptId()}.{os.getpid()}"
            with files.open_output_stream(own) as f:
                f.write(data)
            files.move(own, f"{folder}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.entries]), pa.array([writer.ids])], ["name", "entries", "ids"])
            serial, size, writer = serial + 1, 0, None
            return row

        files.create_dir(folder, recursive=True)
        for batch in pieces(batches):
            ids, bounds = enc.encode(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                writer = writer or ShardWriter(width)
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id))
                writer.add(key_of(doc), own)
                size += len(own) * width
                if size >= shard_bytes:
                    yield close()
        if writer:
            yield close()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_n"))
    with small_batches(docs.sparkSession):
        dealt = src.repartitionByRange("doc_id", "_h", "_n").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
        return written(dealt.mapInArrow(run, "name string, entries long, ids long"), "manifest")


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """Every entry of the shards: doc_id, start, n_tokens, ids_crc32."""
    part = F.substring("name", 1, 11)  # of each task
    per = manifest.groupBy(part.alias("part")).agg(F.sum("ids").alias("ids"))
    tasks = per.select("part", (F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("before"))  # one row per task that wrote
    within = F.sum("ids").over(Window.partitionBy("part").orderBy("name").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")
    starts = manifest.withColumn("part", part).withColumn("within", within).join(tasks, "part").select("name", (F.col("before") + F.col("within")).alias("base"))

    def run(batches):
        import pyarrow.fs as pafs

        files, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{folder}/{name}") as f:
                    rows = []
                    for doc, before, ids in ShardReader(f):
                        rows.append((doc, base + before, len(ids), zlib.crc32(ids.astype("<u4"))))
                        if len(rows) == 10_000:
                            yield _token_rows(rows)
                            rows = []
                    if rows:
                        yield _token_rows(rows)

    return starts.repartition("name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _token_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the shards (to ``path``, by default in the shared folder) and reads them back."""
    path = path or scratch(docs.sparkSession, "shards")
    manifest = write_shards(docs, path, tokenizer, end_id)
    if manifest.isEmpty():
        return manifest.select(*[F.lit(0).cast("long").alias(c) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
    return read_shards(manifest, path)
