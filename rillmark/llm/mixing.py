"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents are shuffled by a digest of their id and text and laid end to end; the row of words is cut into
equal blocks of at most ``BLOCK`` words, at least ``LEAST_BLOCKS`` of them where there are as many words. So a
source's blocks differ by a word at most, at every size of input, and a small source has blocks enough to meet its target.
Slots t = 0, 1, 2, ... take the points frac(t * golden ratio), as 64-bit fractions. The sources' targets, counted in their
blocks, cut [0, 1) into one interval per source, so after any number of slots each source's share is within a few slots
of its target. The source's slot of rank r takes block r modulo its number of blocks, at most twice. What a document has
in the blocks of slots is what the mix takes of it; it may be cut between a taken and an untaken block.

At scale: a word count per document is written once (ids, sizes, digests; no texts). Word offsets are running sums in two
levels, over hash buckets and within one, of about the square root of the number of rows each, so a source that holds a
third of all rows is spread like the others. Slots are counted out in ranges, each by its own task: a range's first
ranks come from sums of floors (``below``), without the slots before it. Slots and documents meet on (source, block), of which
none has more than ``BLOCK`` documents. The driver sees one row per source (at most ``MAX_SOURCES``, checked) and no slots.

A null text has 0 words and is never taken; nor is an empty one. Null is a source like others, last in
order; ``""`` is one, too. Repeated rows are separate documents. An empty table gives an empty result.
Other columns keep out of the way: only ids, texts and sources are read.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.util import written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK, LEAST_BLOCKS, MAX_SOURCES = 256, 1024, 100_000
#: Slots of a range.
RANGE = 1 << 18
GOLDEN = 0x9E3779B97F4A7C15


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """``share`` of all words dealt by weight, no source above ``most`` times its own words; what is above is dealt again."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_ and left > 0:
        per = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if per * weights[i] > most * sizes[i]}
        for i in full or open_:
            out[i] = most * sizes[i] if full else per * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def blocks_of(size: int) -> int:
    """Into how many blocks a source of so many words is cut; block k holds words k * size // n up to (k + 1) * size // n."""
    return max(-(-size // BLOCK), min(size, LEAST_BLOCKS))


def plan(sizes: list[int], target: list[float]) -> tuple[list[int], list[int], int]:
    """Blocks per source, the end of each source's interval in units of 2**-64, and the number of slots."""
    blocks = [blocks_of(s) for s in sizes]
    wanted = [t * n / s if s else 0.0 for t, n, s in zip(target, blocks, sizes, strict=True)]
    total, at, ends = sum(wanted), 0.0, []
    for w in wanted:
        at += w
        ends.append(min(2**64, int(at / total * 2**64)) if total else 0)
    if ends and total:
        ends[-1] = 2**64
    return blocks, ends, math.ceil(total)


def points(n: int, first: int = 0) -> np.ndarray:
    """The schedule's points as fractions of 2**64."""
    with np.errstate(over="ignore"):
        return np.arange(first, first + n, dtype=np.uint64) * np.uint64(GOLDEN)


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """The sum of (a * t + b) // m over t = 0 ... n - 1, for a, b >= 0."""
    out = 0
    while n:
        out += n * (n - 1) // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        n, b = divmod(a * n + b, m)
        m, a = a, m
    return out


def below(n: int, cut: int) -> int:
    """How many of the first n points are less than ``cut``."""
    return n + floor_sum(n, 2**64, GOLDEN, 0) - floor_sum(n, 2**64, GOLDEN, 2**64 - cut)


def schedule(spark, blocks: list[int], ends: list[int], slots: int) -> DataFrame:
    """The slots in order: slot, source (its number), rank, block; none beyond a block's second time. A task counts out its own ranges."""
    cut = np.array([min(e, 2**64 - 1) for e in ends[:-1]], np.uint64)
    n = np.array(blocks, np.int64)

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                at = p * RANGE
                point = points(min(RANGE, slots - at), at)
                source = np.searchsorted(cut, point, "right")
                order = np.argsort(source, kind="stable")
                kinds, first, count = np.unique(source[order], return_index=True, return_counts=True)
                low = lambda s: below(at, ends[s - 1]) if s else 0
                before = np.array([(below(at, ends[s]) if ends[s] < 2**64 else at) - low(s) for s in kinds.tolist()], np.int64)
                rank = np.empty(len(source), np.int64)
                rank[order] = np.arange(len(source)) + np.repeat(before - first, count)
                keep = rank < 2 * n[source]
                yield pa.RecordBatch.from_arrays([pa.array(at + np.flatnonzero(keep)), pa.array(source[keep].astype(np.int32)), pa.array(rank[keep]), pa.array((rank % np.maximum(1, n[source]))[keep])], ["slot", "source", "rank", "block"])

    ranges = -(-slots // RANGE)
    return spark.range(0, ranges, 1, max(1, min(ranges, 100_000))).mapInArrow(run, "slot long, source int, rank long, block long")


def taken(docs: DataFrame, *, keep: list[str] = (), weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, slot (the first that takes some of it) per document, and the columns of ``keep``."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    shuffle = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), shuffle.alias("h"), *keep)
    sized = written(sized.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    sized = sized.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    per = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.words for r in per]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(per))])
    blocks, ends, slots = plan(sizes, target)
    facts = [("n" if r.source is None else "s" + r.source, i, r.words, t, b) for i, (r, t, b) in enumerate(zip(per, target, blocks, strict=True))]
    sources = F.broadcast(spark.createDataFrame(facts, "key string, nth int, source_size long, target double, blocks long"))  # at most MAX_SOURCES
    # where each document stands in its source's shuffled row
    buckets = max(1, math.isqrt(sum(r.rows for r in per)))
    sized = sized.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long"))
    sums = sized.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = sums.select("key", "bucket", (F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("base"))
    within = Window.partitionBy("key", "bucket").orderBy("h", "_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("end", F.sum("size").over(within)).join(before, ["key", "bucket"]).join(sources, "key")
    placed = written(placed.withColumn("start", F.col("base") + F.col("end") - F.col("size")).drop("base", "end", "bucket", "h"), "placed")
    # its words in each block that it touches, and that block's slots
    edge = lambda k: F.expr(f"({k} * source_size) div blocks")
    first, last = "((start + 1) * blocks - 1) div source_size", "((start + size) * blocks - 1) div source_size"
    touched = placed.filter("size > 0").select("_row", "nth", "start", "size", "source_size", "blocks", F.explode(F.expr(f"sequence({first}, {last})")).alias("block"))
    words = F.least(F.col("start") + F.col("size"), edge("(block + 1)")) - F.greatest(F.col("start"), edge("block"))
    times = schedule(spark, blocks, ends, slots).groupBy(F.col("source").alias("nth"), "block").agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
    got = touched.withColumn("words", words).join(times.hint("merge"), ["nth", "block"]).groupBy("_row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("slot").alias("slot"))
    return placed.join(got.hint("merge"), "_row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot", *keep)


def mixed(docs: DataFrame, *, weights: tuple = WEIGHTS) -> DataFrame:
    """The mix as whole documents in the order of the schedule: each as often as its words are taken, a cut one if at least half of it is.

    A document's copies stand where a slot first takes some of it.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    digest = F.md5(F.col("text").cast("string"))
    own = docs.select(F.col("doc_id").alias("_id"), digest.alias("_text"), F.col("source").cast("string").alias("_source"), columns)
    got = taken(docs.select("doc_id", "text", "source", digest.alias("_text")), keep=["_text"], weights=weights)
    times = got.filter("taken > 0").groupBy("doc_id", "source", "_text").agg(F.floor(F.avg(F.col("taken") / F.col("size")) + 0.5).cast("int").alias("_times"), F.min("slot").alias("_slot")).filter("_times > 0")
    times = times.select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("_text").alias("_x"), "_times", "_slot")
    joined = own.join(times, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_x")) & F.col("_source").eqNullSafe(F.col("_s")))
    rows = joined.select("_slot", "_row", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("_slot", "_row")
    return rows.repartitionByRange("_slot").sortWithinPartitions("_slot").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def brute_force(docs: list[tuple], weights: tuple = WEIGHTS) -> list[tuple]:
    """(doc_id, source, size, source_size, target, taken) of (doc_id, text, source), word by word and slot by slot, for tests."""
    import hashlib
    import re

    rows = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()) for d, t, s in docs]
    names = sorted({s for _, s, _, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, s, n, _ in rows if s == name) for name in names]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    blocks, ends, slots = plan(sizes, target)
    times, ranks = [[0] * n for n in blocks], [0] * len(names)
    for t in range(slots):
        i = bisect_right(ends[:-1], t * GOLDEN % 2**64)
        if ranks[i] < 2 * blocks[i]:
            times[i][ranks[i] % blocks[i]] += 1
        ranks[i] += 1
    out = []
    for i, name in enumerate(names):
        at, block = 0, 0
        for d, s, n, _ in sorted((r for r in rows if r[1] == name), key=lambda r: r[3]):
            got = 0
            for word in range(at, at + n):
                while (block + 1) * sizes[i] // blocks[i] <= word:
                    block += 1
                got += times[i][block]
            out.append((d, s, n, sizes[i], target[i], got))
            at += n
    return out
