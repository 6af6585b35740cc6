"""Benchmark decontamination by Wu-Manber multi-pattern search.

The symbols are words. Every run of ``window`` consecutive words of a benchmark item is a pattern (an
item of fewer words is one pattern). For each pattern length m a table maps a block of two words to how
far a window's end may move without passing an occurrence; only where that is 0 are patterns looked up, by the hashes of
their last and of their first block together, and compared with the text, word by word and then byte by byte.
Equal windows of several items are one pattern with several owners, so a lookup finds few.

Documents stay where they are: no shuffle. The items are written to the shared folder and each worker reads them from
there in blocks of at most ``block_bytes`` of text (or one longer item): nothing is broadcast and no item passes the driver.
A worker keeps compiled blocks of up to ``KEEP_BYTES`` of text; where there are more, it searches ``AHEAD_BYTES`` of
documents at a time with each of the others in turn, so memory stays bounded and no item is dropped.

Null, empty or wordless texts and items have no words: such a document is clean and such an item never
occurs. Repeated documents each give their row; rows that repeat an item's id are one item. An item without an id is
an item of its own: it is searched for, counted in n_items, and stands for an empty string in items_sha256. Ties cannot
occur. Other columns are passed through; one that is called like the result is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm.util import LOWER, PLAIN_WORDS, U64, Words, mix, pieces, same_ranges, scratch, words

SEGMENT = 4096
KEEP_BYTES, AHEAD_BYTES = 32 << 20, 32 << 20
#: Pairs of a place and a pattern that are compared at a time.
PAIRS = 1 << 20
_NONE = "\0"  # begins the name of an item without an id


class WuManber:
    """Search for the windows of ``m`` words of some items in arrays of word hashes."""

    def __init__(self, m: int, items: Words, start: np.ndarray, owner: np.ndarray, names: list[str]):
        """start: each pattern's first word in ``items``; owner: its item's place in names."""
        self.m, self.width, self.items, self.names = m, min(2, m), items, names
        order, whole = self._apart(start)
        new = np.concatenate([[True], whole[1:] != whole[:-1]])
        self.start = start[order][new]
        #: pattern i belongs to the items owner[first[i]:first[i + 1]]
        self.first, self.owner = np.append(np.flatnonzero(new), len(order)), owner[order]
        self.bits = max(10, int(8 * len(self.start) * m).bit_length())
        self.shift = np.full(1 << self.bits, m - self.width + 1, np.uint16)
        for end in range(self.width - 1, m):
            np.minimum.at(self.shift, self._slot(self._block(items.hash, self.start + end)), m - 1 - end)
        ends = self._ends(items.hash, self.start)
        order = np.argsort(ends, kind="stable")
        self.ends, self.order = ends[order], order

    def _apart(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patterns in an order in which equal ones stand together, and a number that differs between unequal ones."""
        h = np.zeros(len(start), U64)
        for i in range(self.m):
            h = mix(h * U64(0x9E3779B97F4A7C15) + self.items.hash[start + i])
        order = np.argsort(h, kind="stable")
        a, b = start[order][:-1], start[order][1:]
        alike = np.ones(len(a), bool)
        for i in range(self.m):
            alike &= self.items.hash[a + i] == self.items.hash[b + i]
        return order, np.concatenate([[0], np.cumsum(~alike)])

    def _block(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The hash of the block of words that ends at ``last``."""
        return mix(h[last] if self.width == 1 else h[last - 1] * U64(0x9E3779B97F4A7C15) + h[last])

    def _slot(self, block):
        return (block >> U64(64 - self.bits)).astype(np.int64)

    def _ends(self, h: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The hash of a window's last and first block."""
        return mix(self._block(h, start + self.m - 1) + U64(0xD6E8FEB86659FD93) * self._block(h, start + self.width - 1))

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """End positions where the shift is 0. All segments of all documents advance together."""
        m = self.m
        lengths = np.diff(bounds)
        cuts = np.maximum(0, (lengths - m + SEGMENT) // SEGMENT)  # segments whose ends are SEGMENT apart
        row = np.repeat(np.arange(len(lengths)), cuts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at = bounds[row] + m - 1 + nth * SEGMENT
        stop = np.minimum(at + SEGMENT, bounds[row + 1])
        found = []
        while len(at):
            step = self.shift[self._slot(self._block(h, at))]
            zero = step == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(step, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def matches(self, w: Words, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of every occurrence; the text of ``w`` is in lower case."""
        ends = self.candidates(w.hash, bounds)
        key = self._ends(w.hash, ends - self.m + 1) if len(ends) else np.zeros(0, U64)
        lo, n = np.searchsorted(self.ends, key, "left"), np.searchsorted(self.ends, key, "right")
        ends, lo, n = ends[n > lo], lo[n > lo], (n - lo)[n > lo]
        stop, out = np.cumsum(n), [(np.zeros(0, np.int64),) * 2]
        at = 0
        while at < len(ends):  # at least one place, and about PAIRS pairs, at a time
            to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + PAIRS, "right")))
            k = n[at:to]
            end = np.repeat(ends[at:to], k)
            pattern = self.order[np.repeat(lo[at:to] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            for back in range(self.m):
                same = w.hash[end - back] == self.items.hash[self.start[pattern] + self.m - 1 - back]
                end, pattern = end[same], pattern[same]
            for back in range(self.m):
                x, y = end - back, self.start[pattern] + self.m - 1 - back
                size = w.end[x] - w.start[x]
                same = size == self.items.end[y] - self.items.start[y]
                same[same] = same_ranges(w.data, w.start[x[same]], self.items.data, self.items.start[y[same]], size[same])
                end, pattern = end[same], pattern[same]
            out.append((end, pattern))
            at = to
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def owners(self, pattern: int) -> list[str]:
        return [self.names[i] for i in self.owner[self.first[pattern] : self.first[pattern + 1]]]


def lowered(w: Words) -> Words:
    w.data = LOWER[w.data]
    return w


def compile_items(items: list[tuple[str, str | None]], window: int) -> list[WuManber]:
    """One searcher for each pattern length."""
    w = lowered(words(pa.array([t for _, t in items], pa.large_string()), PLAIN_WORDS))
    bounds, size = w.bounds(), w.counts()
    m, names = np.minimum(size, window), [n for n, _ in items]
    out = []
    for length in np.unique(m[m > 0]).tolist():
        mine = np.flatnonzero(m == length)
        n = size[mine] - length + 1
        owner = np.repeat(mine, n)
        start = np.repeat(bounds[:-1][mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append(WuManber(length, w, start, owner, names))
    return out


class Items:
    """The written items as searchers; those that fit keep_bytes stay compiled."""

    def __init__(self, path: str, window: int, block_bytes: int, keep_bytes: int):
        self.path, self.window, self.block_bytes = path, window, block_bytes
        self.kept, size, self.more = [], 0, False
        for block, n in self._blocks(0):
            if size + n > keep_bytes and self.kept:
                self.more = True
                break
            self.kept.append(compile_items(block, window))
            size += n

    def _blocks(self, skip: int) -> Iterator[tuple[list[tuple], int]]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        files, folder = pafs.FileSystem.from_uri(self.path)
        names = sorted(f.path for f in files.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet"))
        block, size, done, nameless = [], 0, 0, 0
        for name in names:
            for batch in pq.ParquetFile(name, filesystem=files).iter_batches(256):
                for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    n = len(text.encode()) if text else 0
                    if block and size + n > self.block_bytes:
                        done += 1
                        if done > skip:
                            yield block, size
                        block, size = [], 0
                    nameless += item is None
                    block.append((f"{_NONE}{nameless}" if item is None else item, text))
                    size += n
        if block and done + 1 > skip:
            yield block, size

    def __iter__(self) -> Iterator[list[WuManber]]:
        yield from self.kept
        if self.more:
            for block, _ in self._blocks(len(self.kept)):
                yield compile_items(block, self.window)


def _ahead(batches, most: int):
    """Batches put together up to about ``most`` bytes of their second column."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]


def _found(column: pa.Array, searchers) -> pa.StructArray:
    """(n_words, spans, items) of each text of a column."""
    w = lowered(words(column, PLAIN_WORDS))
    bounds = w.bounds()
    starts, ends, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
    for block in searchers:
        for s in block:
            end, pattern = s.matches(w, bounds)
            starts.append(end - s.m + 1)
            ends.append(end + 1)
            for row, p in set(zip(w.row[end].tolist(), pattern.tolist(), strict=True)):
                found.setdefault(row, set()).update(s.owners(p))
    start, end = np.concatenate(starts), np.concatenate(ends)
    depth = np.bincount(start, minlength=len(w.hash) + 1).astype(np.int64) - np.bincount(end, minlength=len(w.hash) + 1)
    hit = np.concatenate([[False], np.cumsum(depth)[:-1] > 0, [False]])
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    lo, hi = edge[::2], edge[1::2]
    # windows of neighbouring documents may touch: cut at the documents' bounds
    inner = np.unique(bounds[1:-1]) if len(bounds) > 2 else np.zeros(0, np.int64)
    inner = inner[(inner > 0) & (inner < len(w.hash))]
    inner = inner[hit[inner + 1] & hit[inner]] if len(inner) else inner
    lo, hi = np.sort(np.concatenate([lo, inner])), np.sort(np.concatenate([hi, inner]))
    row = w.row[lo] if len(lo) else lo
    offsets = pa.array(np.searchsorted(row, np.arange(w.rows + 1)).astype(np.int32))
    base = bounds[row] if len(row) else row
    spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(lo - base, pa.int64()), pa.array(hi - base, pa.int64())], ["start", "end"]))
    names = pa.array([sorted("" if x.startswith(_NONE) else x for x in found.get(i, ())) for i in range(w.rows)], pa.list_(pa.string()))
    return pa.StructArray.from_arrays([pa.array(w.counts(), pa.int64()), spans, names], ["n_words", "spans", "items"])


def _searched(docs: DataFrame, items: DataFrame, keep: list[str], *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20, keep_bytes: int = KEEP_BYTES) -> DataFrame:
    """(row, contamination): the kept columns as one, and what was found."""
    path = scratch(docs.sparkSession, "benchmark")
    items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text")).write.mode("append").parquet(path)
    shape = T._parse_datatype_string("struct<n_words: long, spans: array<struct<start: long, end: long>>, items: array<string>>")
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("searched"))

    def search(batches):
        searchers = Items(path, window, block_bytes, keep_bytes)
        for batch in _ahead(pieces(batches), AHEAD_BYTES if searchers.more else 0):
            yield pa.RecordBatch.from_arrays([batch.column("row"), _found(batch.column("searched"), searchers)], ["row", "contamination"])

    return src.mapInArrow(search, T.StructType([src.schema["row"], T.StructField("contamination", shape)]))


def contamination(docs: DataFrame, items: DataFrame, *, keep: list[str] | None = None, **options) -> DataFrame:
    """Adds to each document ``contamination``: (n_words, hit word ranges [start, end), ids of the items found, as strings).

    keep: the document columns to return (default: all of them). Options are those of `_searched`: the columns' names, the
    window, and the bytes of a block and of the blocks that a worker keeps.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "contamination"]
    out = _searched(docs, items, keep, **options)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "contamination")


def digest(names: F.Column) -> F.Column:
    """SHA-256 of sorted strings, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(names), ","), 256)


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    c = F.col("contamination")
    n_hit = F.aggregate(c.getField("spans"), F.lit(0).cast("long"), lambda a, s: a + s.getField("end") - s.getField("start"))
    return contamination(docs, items, keep=["doc_id"], **options).select(
        "doc_id", c.getField("n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(c.getField("items")).cast("long").alias("n_items"), digest(c.getField("items")).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no window occurs, with all their columns."""
    out = _searched(docs, items, docs.columns, **options)
    return out.filter(F.size("contamination.spans") == 0).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def brute_force(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """The report by plain search, for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for nth, (item, t) in enumerate(items):
        x = split(t)
        m = min(window, len(x))
        for i in range(len(x) - m + 1) if m else ():
            windows.setdefault(tuple(x[i : i + m]), set()).add((str(item), 0) if item is not None else ("", nth))
    out = []
    for doc, t in docs:
        x, hit, names = split(t), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(x) - m + 1):
                if got := windows.get(tuple(x[i : i + m])):
                    hit.update(range(i, i + m))
                    names |= got
        out.append((doc, len(x), len(hit), len(names), hashlib.sha256(",".join(sorted(n for n, _ in names)).encode()).hexdigest(), bool(hit)))
    return out
