"""Near-duplicate groups by Order MinHash, verified by banded alignment.

Words are lower-cased runs of letters, digits and non-ASCII characters; a k-mer is ``K`` = 5 of them in a
row, labelled with its occurrence number in the document (a shorter text is one k-mer). A sketch element
takes the ``ELL`` k-mers with the smallest hashes under one hash function and keeps their text order, so
it agrees for two texts when their k-mers agree *and* come in the same order. A text has ``ELEMENTS`` of
them; two texts that share one are candidates. With a k-mer similarity of 0.8 one element agrees with a
probability of about 0.8 ** ELL, and all elements miss with (1 - 0.8 ** ELL) ** ELEMENTS (5e-5).

A candidate pair is a link if its k-mer multisets have a Jaccard similarity of at least 0.8 and an
alignment in a band of 20 % of the longer text's words finds an edit similarity of at least 0.8.

At scale: equal texts collapse first: a node is a distinct text, told by 128 bits of SHA-256. A bucket (element) of n
texts gives at first 2 n candidates: each text with the bucket's least node, and, where one of two texts that are
neighbours in the order of their other elements isn't linked to that, those two. Links become groups by label
propagation with pointer jumping, on tables in the shared folder. Then the texts of buckets that hold several groups are
compared across groups (``rest``): all pairs but those that an exact bound rules out, so groups depend neither on the order
nor on the partitions of the input. With the k-mers of each text put into one common order, rare ones first, two texts
of the similarity share one of the first 20 % of each, at places that leave enough k-mers behind them. The order comes
from hashed counts; an inexact count costs time, never a pair. A k-mer of many texts is joined in square blocks. Pairs
within a group aren't compared further, since they can't change it. Where one text, bucket, node or group may hold a third
of all rows, joins deal its rows over many tasks (``util.spread_join``). Only texts that are somebody's candidate are
written a second time. Nothing but counters reaches the driver.

Nulls: a document with null text is a group of its own, as is a null id (which stays null). Texts without words are
copies of each other only if they are equal. A group's id is its least doc_id; rows that repeat a doc_id with
different texts are judged by their texts. Ids are whole numbers. An empty table gives an empty result. Other columns
are not touched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.util import PLAIN_WORDS, U64, mix, pieces, remove, salted, spread_join, words, written

K, ELL, ELEMENTS, SIMILARITY = 5, 3, 14, 0.8
#: Low bits of a hashed k-mer that hold its position.
PLACE = 28
_MOST = U64(0xFFFFFFFFFFFFFFFF)
#: Counters of k-mers by their low bits, for the order of ``rest``.
COUNTERS = 1 << 18
#: Pairs of one k-mer that one block of its join has, about.
BLOCK_PAIRS = 1 << 20


def kmers(h: np.ndarray, bounds: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of each document's words, and each document's bounds in them."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    at = bounds[doc] + np.arange(len(doc)) - to[doc]
    x = np.zeros(len(doc), U64)
    for i in range(k):
        inside = at + i < bounds[doc + 1]
        x = mix(x * U64(0x9E3779B97F4A7C15) + np.where(inside, h[np.minimum(at + i, len(h) - 1)], U64(i)) + U64(1)) if len(h) else x
    # the occurrence number: the rank among equal k-mers of the document
    key = mix(x + doc.astype(U64) * U64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    if same.any():
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        rank = np.empty(len(order), U64)
        rank[order] = run
        x = np.where(rank > 0, mix(x + rank * U64(0xA24BAED4963EE407)), x)
    return x, to


def sketch(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of ELEMENTS hashes for each document that has k-mers (the others' rows are 0)."""
    n = np.diff(bounds)
    out = np.zeros((len(n), ELEMENTS), U64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    first = bounds[some]
    place = (np.arange(len(x)) - np.repeat(first, n[some])).astype(U64)
    for e in range(ELEMENTS):
        v = mix(x ^ U64(0x5851F42D4C957F2D * (e + 1) % 2**64)) & ~U64((1 << PLACE) - 1) | place
        least = []
        for _ in range(ELL):
            low = np.minimum.reduceat(v, first)
            least.append(low)
            v[first + (low & U64((1 << PLACE) - 1)).astype(np.int64) * (low != _MOST)] = _MOST
        least = np.array(least)
        spots = np.where(least == _MOST, _MOST, least & U64((1 << PLACE) - 1))
        # the chosen k-mers in text order
        kmer = np.where(spots == _MOST, U64(1), x[first + np.where(spots == _MOST, U64(0), spots).astype(np.int64)])
        kmer = np.take_along_axis(kmer, np.argsort(spots, axis=0, kind="stable"), axis=0)
        value = np.full(len(some), e + 1, U64)
        for row in kmer:
            value = mix(value * U64(0x9E3779B97F4A7C15) + row)
        out[some, e] = value
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The words to insert, delete or replace, by furthest-reaching points in a band of ``most`` diagonals; None if over ``most``."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    size = 1 << 12
    reach = {0: _run(a, b, 0, 0, size)}
    prev = np.array([reach[0]], np.int64)  # by diagonal -e..e: the furthest index in a
    if n == m == prev[0]:
        return 0
    for e in range(1, most + 1):
        d = np.arange(-e, e + 1)  # b's index minus a's
        pad = np.full(len(prev) + 4, -2, np.int64)
        pad[2:-2] = prev
        # replace: same diagonal, +1; delete from a: diagonal d+1, +1; insert: diagonal d-1, +0
        x = np.maximum(np.maximum(pad[1:-1] + 1, pad[2:] + 1), pad[:-2])
        x = np.minimum(np.minimum(x, n), m - d)
        ok = (x >= 0) & (x + d >= 0)
        x = np.where(ok, x, -2)
        x = _extend(a, b, x, d)
        at = m - n
        if -e <= at <= e and x[at + e] >= n:
            return e
        prev = x
    return None


def _run(a, b, i, j, size):
    """Where a[i:] and b[j:] stop to agree, as an index in a."""
    while True:
        k = min(size, len(a) - i, len(b) - j)
        if k <= 0:
            return i
        differ = np.flatnonzero(a[i : i + k] != b[j : j + k])
        if len(differ):
            return i + int(differ[0])
        i, j = i + k, j + k


def _extend(a, b, x, d):
    """Moves every point along its diagonal while the words agree: all at once for a few words, then one by one."""
    n, m = len(a), len(b)
    live = np.flatnonzero((x >= 0) & (x < n) & (x + d < m))
    for _ in range(3):
        live = live[a[x[live]] == b[x[live] + d[live]]]
        if not len(live):
            return x
        x[live] += 1
        live = live[(x[live] < n) & (x[live] + d[live] < m)]
    for i in live.tolist():
        x[i] = _run(a, b, int(x[i]), int(x[i] + d[i]), 256)
    return x


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> bool:
    """a, b: word hashes and sorted k-mers of two texts."""
    shared = len(np.intersect1d(a[1], b[1], assume_unique=True))
    if shared < least * (len(a[1]) + len(b[1]) - shared):
        return False
    longest = max(len(a[0]), len(b[0]))
    return edit_distance(a[0], b[0], int((1 - least) * longest + 1e-9)) is not None


def _parts(column: pa.Array):
    w = words(column, PLAIN_WORDS)
    bounds = w.bounds()
    x, to = kmers(w.hash, bounds)
    return w, bounds, x, to


def digest(text: F.Column) -> F.Column:
    """What `_sketches` calls a text by."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _sketches(batches):
    for batch in pieces(batches):
        _, _, x, to = _parts(batch.column(1))
        s = sketch(x, to).view(np.int64)
        has = np.diff(to) > 0
        elements = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * ELEMENTS)]).astype(np.int32)), pa.array(s[has].reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(t.as_buffer()).digest()[:16] for t in batch.column(1)], pa.binary()), elements], ["doc_id", "digest", "elements"])


def _verify(batches):
    """(a, b, text_a, text_b) to (a, b, ok); equal neighbours' a is opened once."""
    last, opened = None, None
    for batch in pieces(batches, 3):
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        _, bounds, x, to = (wb := _parts(batch.column("text_b")))
        ok = []
        for i in range(len(a)):
            if a[i] != last:
                w, bo, xa, ta = _parts(batch.column("text_a").slice(i, 1))
                last, opened = a[i], (w.hash, np.sort(xa))
            ok.append(alike(opened, (wb[0].hash[bounds[i] : bounds[i + 1]], np.sort(x[to[i] : to[i + 1]]))))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def _neighbours(batches):
    """Sorted (bucket, place, doc, ok): neighbours in a bucket of which one isn't linked to its least id."""
    before = None
    for batch in batches:
        key, doc, ok = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "doc", "ok"))
        if before is not None:
            key, doc, ok = np.concatenate([[before[0]], key]), np.concatenate([[before[1]], doc]), np.concatenate([[before[2]], ok])
        take = (key[1:] == key[:-1]) & ~(ok[1:] & ok[:-1]) & (doc[1:] != doc[:-1])
        x, y = doc[:-1][take], doc[1:][take]
        if len(doc):
            before = key[-1], doc[-1], ok[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _frequencies(batches):
    """(node, text) to (slot, n): the task's k-mers by their low bits."""
    n = np.zeros(COUNTERS, np.int64)
    for batch in pieces(batches):
        x = _parts(batch.column(1))[2]
        n += np.bincount((x & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["slot", "n"])


def _prefixes(counts: np.ndarray):
    """(node, text) to (kmer, doc, at, size): of each text's k-mers, rare ones first, those of which a similar text has one."""

    def run(batches):
        for batch in pieces(batches):
            _, _, x, to = _parts(batch.column(1))
            size = np.diff(to)
            doc = np.repeat(np.arange(len(size)), size)
            x = x[np.lexsort((x, counts[(x & U64(COUNTERS - 1)).astype(np.int64)], doc))]
            at, size = np.arange(len(x)) - to[doc], size[doc]
            keep = at <= size - np.ceil(SIMILARITY * size - 1e-9)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[doc[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)), pa.array(ids), pa.array(at[keep]), pa.array(size[keep])], ["kmer", "doc", "at", "size"])

    return run


def rest(members: DataFrame, labels: DataFrame, opened: DataFrame) -> DataFrame:
    """(a, b): the pairs of different groups in buckets of several groups that may have the similarity."""
    placed = members.join(labels, members.doc == labels.node, "left").select("bucket", "doc", F.coalesce("label", "doc").alias("label"))
    several = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo <> hi and n > 2").select("bucket")
    docs = written(placed.join(several, "bucket", "left_semi").select("doc", "label").distinct(), "open")
    texts = opened.join(docs.select(F.col("doc").alias("node")), "node", "left_semi").select("node", "text")
    told = texts.mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, np.int64)
    counts[told.column("slot").to_numpy()] = told.column("n").to_numpy()
    rows = written(texts.mapInArrow(_prefixes(counts), "kmer long, doc long, at long, size long").join(docs, "doc"), "prefixes")
    per = rows.groupBy("kmer", "label").agg(F.count("*").alias("n"), F.min("size").alias("least"))
    per = per.groupBy("kmer").agg(F.max_by("label", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.min("least").alias("least")).filter("n > most")
    # a row's k-mer has enough others behind it only for texts of up to this size
    longest = (F.col("size") - F.col("at")) * ((1 + SIMILARITY) / SIMILARITY) - F.col("size") + 1e-6
    shared = written(rows.join(per, "kmer").filter(longest >= F.col("least")).select("kmer", "doc", "at", "size", "label", "main", F.ceil(F.sqrt((F.col("n") - F.col("most")) * F.col("n") / BLOCK_PAIRS)).alias("side")), "shared")
    own, every = F.pmod(F.xxhash64("doc"), F.col("side")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1))
    x = shared.filter("label <> main").select("kmer", own.alias("r"), every.alias("c"), *[F.col(k).alias(f"{k}_x") for k in ("doc", "at", "size", "label")])
    y = shared.select("kmer", own.alias("c"), every.alias("r"), "main", *[F.col(k).alias(f"{k}_y") for k in ("doc", "at", "size", "label")])
    once = (F.col("label_x") != F.col("label_y")) & ((F.col("label_y") == F.col("main")) | (F.col("doc_x") < F.col("doc_y")))
    enough = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y")) * (1 + SIMILARITY) >= SIMILARITY * (F.col("size_x") + F.col("size_y")) - 1e-6
    near = F.least("size_x", "size_y") >= SIMILARITY * F.greatest("size_x", "size_y") - 1e-6
    return x.join(y, ["kmer", "r", "c"]).filter(once & enough & near).select(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b): each node's least reachable id. Rounds grow with the logarithm of a path's length.

    A round takes each node's least neighbouring label (partial sums; the hub of a star is one key of many
    equal-sized rows, which AQE splits) and then its label's label, and writes the result.
    """
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), "links")
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    while True:
        named = spread_join(both, labels.withColumnRenamed("node", "v"), ["v"], ["u"])  # the hub of a star is many links' v
        near = named.groupBy("u").agg(F.min("label").alias("near"))
        took = labels.join(near, labels.node == near.u).select("node", "label", F.least("label", "near").alias("took"))
        of = labels.select(F.col("node").alias("took"), F.col("label").alias("further"))
        after = spread_join(took, of, ["took"], ["node"], "left").select("node", F.least("took", F.coalesce("further", "took")).alias("label"), F.col("label").alias("old"))
        after = written(after, "labels")
        remove(labels)
        changed = not after.filter("label <> old").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            remove(both)
            return labels


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, class_id, class_size, rep) of rows with an id and a text (rep: the digest of the group's own text), and the source rows."""
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    known = src.filter("doc_id is not null and text is not null")
    sketched = written(salted(known.mapInArrow(_sketches, "doc_id long, digest binary, elements array<long>"), "doc_id"), "sketches")
    # copies of a text collapse in two steps, so that no task has them all: by share, then by text
    shares = written(sketched.groupBy("digest", "_salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.any_value("elements").alias("elements")), "shares")
    texts = shares.groupBy("digest").agg(F.min("least").alias("least"), F.any_value("elements").alias("elements"))
    # nodes are numbered by least id: a bucket's hub, its least node, is the earliest text, of which later ones are often copies
    texts = written(texts.repartitionByRange("least", "digest").sortWithinPartitions("least", "digest").withColumn("node", F.monotonically_increasing_id()), "texts")
    further = lambda k: F.element_at("elements", (F.col("i") + k) % ELEMENTS + 1)
    rows = texts.select(F.col("node").alias("doc"), "elements", F.posexplode("elements").alias("i", "bucket")).select("bucket", "doc", further(1).alias("p1"), further(2).alias("p2"))
    hubs = rows.groupBy("bucket").agg(F.min("doc").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = written(spread_join(rows, hubs, ["bucket"], ["doc"]), "members")
    open_ = members.select(F.col("doc").alias("node")).distinct().join(texts.select("node", "least", "digest"), "node")
    opened = known.join(open_, known.doc_id == open_.least).filter(F.col("digest") == digest(F.col("text"))).groupBy("node").agg(F.any_value("text").alias("text"))
    opened = written(opened, "opened")
    star = members.filter("doc <> least").select(F.col("least").alias("a"), F.col("doc").alias("b")).distinct()
    checked = written(_checked(star, opened), "star")
    good = checked.filter("ok").select(F.col("a").alias("least"), F.col("b").alias("doc"), F.lit(True).alias("linked"))
    sorted_ = members.join(good, ["least", "doc"], "left").select("bucket", "p1", "p2", "doc", (F.coalesce("linked", F.lit(False)) | (F.col("doc") == F.col("least"))).alias("ok")).repartitionByRange("bucket", "p1", "p2", "doc").sortWithinPartitions("bucket", "p1", "p2", "doc")
    chain = sorted_.mapInArrow(_neighbours, "a long, b long").distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
    compared = checked.unionByName(written(_checked(chain, opened), "chain"))
    links = written(compared.filter("ok").select("a", "b"), "linked")
    labels = components(links)
    more = written(_checked(rest(members, labels, opened).join(compared.select("a", "b"), ["a", "b"], "left_anti"), opened), "rest").filter("ok").select("a", "b")
    if not more.isEmpty():
        links = written(links.unionByName(more), "linked")
        labels = components(links)
    # a group's facts from its texts' shares, then back to these, and from these to the rows
    labelled = texts.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    labelled = written(shares.select("digest", "_salt", "least", "n").join(labelled, "digest"), "labelled")
    groups = labelled.groupBy("label").agg(F.min(F.struct("least", "digest")).alias("first"), F.sum("n").alias("class_size"))
    groups = groups.select("label", F.col("first.least").alias("class_id"), F.col("first.digest").alias("rep"), "class_size")
    facts = spread_join(labelled.select("digest", F.col("_salt").alias("share"), "label"), groups, ["label"], ["digest", "share"]).drop("label")
    rows = sketched.select("doc_id", "digest", F.col("_salt").alias("share"))
    return rows.join(facts, ["digest", "share"]).select("doc_id", "digest", "class_id", "class_size", "rep"), src


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, is_representative (the row, and its repetitions, that stands for the group)."""
    found, src = _grouped(docs, doc_id, text)
    out = found.select("doc_id", "class_id", "class_size", ((F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("rep"))).alias("is_representative"))
    alone = src.filter("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("is_representative"))
    return out.unionByName(alone)


def _checked(pairs: DataFrame, opened: DataFrame) -> DataFrame:
    """(a, b, ok): the texts travel once for b and once for a and share; pairs of one a and share stay together."""
    texts = lambda end: opened.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
    dealt = salted(written(pairs, "pairs"), "b")
    left = dealt.select("a", "_salt").distinct().join(texts("a"), "a")
    both = dealt.join(texts("b"), "b").join(left, ["a", "_salt"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verify, "a long, b long, ok boolean")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: of its rows with the least id the one whose text's digest is least.

    Rows without an id or a text stay. Of rows that repeat an id and a text one stays: where other columns differ,
    the one whose hash is least, so that reruns agree.
    """
    found, _ = _grouped(docs, doc_id, text)
    gone = found.filter((F.col("doc_id") != F.col("class_id")) | (F.col("digest") != F.col("rep"))).select("doc_id", "digest").distinct()
    again = written(found.filter((F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("rep"))).groupBy("doc_id", "digest").count().filter("count > 1"), "repeated")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, F.col(f"`{doc_id}`").cast("long").alias("_i"), F.col(f"`{text}`").cast("string").alias("_t")).select("_row", "_i", F.when(F.col("_i").isNotNull(), digest(F.col("_t"))).alias("_d"))
    kept = keyed.join(gone, (F.col("_i") == F.col("doc_id")) & (F.col("_d") == F.col("digest")), "left_anti")
    if not again.isEmpty():
        mine = (F.col("_i") == F.col("doc_id")) & (F.col("_d") == F.col("digest"))
        hashed = F.xxhash64(*[F.col("_row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
        one = kept.join(again, mine, "left_semi").groupBy("_i", "_d").agg(F.min_by("_row", hashed).alias("_row")).select("_row")
        return kept.join(again, mine, "left_anti").select("_row.*").unionByName(one.select("_row.*"))
    return kept.select("_row.*")
