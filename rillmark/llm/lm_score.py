"""Language-model scoring by deleted interpolation.

    P(w | v) = l2[b] * c(v w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1),   b = b(v), l2 + l1 + l0 = 1

``b(v)`` is the bucket of the context's frequency (its binary logarithm); each bucket has its own three weights. They are
learned by expectation-maximisation on a fold of the training documents that is left out of the counts meanwhile;
the scores then use the counts of all training documents, that fold's too.

A shuffle of every n-gram occurrence, and one back, would be many times the input. Instead:

1. ``blocks``: each task packs its documents into blocks of about a million tokens: the block's distinct
   words as sorted 64-bit hashes, and each token as an index into them. They are written once; from
   here on a block's content is fixed whatever is lost or run again.
2. Each block sends its distinct uni- and bigrams with their counts, as compressed sorted differences,
   to reducers by ranges of the hash. A frequent n-gram is one entry per block, so no key is hot, and
   reducers are as many as the entries ask for.
3. A reducer sums them and sends each block the totals of just its entries, in its order.
4. Each block turns the totals into per-token counts, written once; both the fold's statistics and the scores
   are read from these. For EM, tokens whose probabilities agree to 1/STEPS of a factor of 2 share a cell; a cell keeps
   the exact sums of its probabilities (whole numbers, so that reruns agree), not the rounded ones.

All counts cover all training documents, at every size. Words and word pairs are told apart by 64-bit hashes: among n
distinct ones about n*n/2**65 are taken for another (3 of 10 billion).

Null text is empty text: one end token. A null id has no remainder: such a document is trained on and not held out. Ids
are whole numbers. A repeated document is counted and scored as often as it occurs. An empty table gives an empty
result. Extra columns are ignored; only the id and the text are read.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.util import SPACED_WORDS, U64, mix, pack, pack_sorted, pieces, release, remove, unpack, unpack_sorted, words, written

END, BEGIN = U64(0xE17A146669257AE7), U64(0xB0ABAB0DBD5BA01D)
HELD_OUT, FOLD, CORE = 0, 1, 2
NO_ID = 4  # a flag beside the fold
BLOCK_TOKENS = 1 << 20
#: Entries (distinct n-grams of one block) that one reducer's group holds, about.
GROUP_ENTRIES = 2 << 20
#: Cells per factor of 2 of each probability when the weights are learned, and the units in which their sums are kept.
STEPS, UNIT = 8, 1 << 40
_BLOCK = "block long, docs binary, folds binary, lengths binary, vocabulary binary, tokens binary, n_tokens long, n_entries long"


def bigrams(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Their sorted differences are most of what is shuffled."""
    return mix(mix(before ^ U64(0xD6E8FEB86659FD93)) ^ after)


def _blocks(batches):
    """(doc_id, text, fold) batches into rows of _BLOCK."""
    from pyspark import TaskContext

    part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0

    def close():
        nonlocal serial, held, size
        ids, folds, lengths, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        vocabulary, tokens = np.unique(hashes, return_inverse=True)
        n_pairs = len(np.unique(bigrams(np.concatenate([[BEGIN], hashes[:-1]]).astype(U64), hashes)))
        row = [(part << 24) + serial, pack(ids.view(U64)), pack(folds.astype(U64)), pack(lengths.astype(U64)), pack_sorted(vocabulary), pack(tokens.astype(U64)), len(tokens), len(vocabulary) + n_pairs]
        serial, held, size = serial + 1, [], 0
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS, strict=True)], _NAMES)

    for batch in pieces(batches):
        w = words(batch.column(1), SPACED_WORDS)
        lengths = w.counts() + 1  # with the end token
        h = np.full(int(lengths.sum()), END, U64)
        stop = np.cumsum(lengths)
        inside = np.ones(len(h), bool)
        inside[stop - 1] = False
        h[inside] = w.hash
        ids, folds = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(ids):  # documents are never cut; a block ends after the one that fills it
            before = int(stop[at - 1]) if at else 0
            to = min(len(ids), int(np.searchsorted(stop, before + BLOCK_TOKENS - size)) + 1)
            held.append((ids[at:to], folds[at:to], lengths[at:to], h[before : int(stop[to - 1])]))
            size += int(stop[to - 1]) - before
            at = to
            if size >= BLOCK_TOKENS:
                yield close()
    if held:
        yield close()


_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]
_KINDS = [pa.binary() if x.split()[1] == "binary" else pa.int64() for x in _BLOCK.split(", ")]


class Block:
    """A row of _BLOCK, opened: tokens with their predecessors, and the block's distinct uni- and bigrams."""

    def __init__(self, row: dict):
        self.ids, self.folds, self.lengths = unpack(row["docs"]).view(np.int64), unpack(row["folds"]).astype(np.int8), unpack(row["lengths"]).astype(np.int64)
        self.vocabulary, self.tokens = unpack_sorted(row["vocabulary"]), unpack(row["tokens"]).astype(np.int32)
        h = self.vocabulary[self.tokens]
        self.first = np.cumsum(self.lengths) - self.lengths
        before = np.concatenate([[BEGIN], h[:-1]]).astype(U64)
        before[self.first] = BEGIN
        self.pairs, self.pair = np.unique(bigrams(before, h), return_inverse=True)
        self.fold = np.repeat(self.folds & 3, self.lengths)

    def counts(self) -> list[np.ndarray]:
        """Of the unigrams in the core and in the fold, of the bigrams in the core and in the fold."""
        return [np.bincount(x[self.fold == f], minlength=n) for x, n in ((self.tokens, len(self.vocabulary)), (self.pair, len(self.pairs))) for f in (CORE, FOLD)]


def _edges(groups: int) -> np.ndarray:
    """The first hash of each reducer's range but the first."""
    return np.array([(i << 64) // groups for i in range(1, groups)], U64)


_COUNTS = ("core", "fold", "pair", "pair_fold")


def _requests(groups: int):
    edges = _edges(groups)

    def run(batches):
        for batch in batches:
            release()
            for row in batch.to_pylist():
                b = Block(row)
                counts = b.counts()
                u, p = ([0, *np.searchsorted(x, edges), len(x)] for x in (b.vocabulary, b.pairs))
                part = lambda x, at, g: x[at[g] : at[g + 1]]
                rows = [(g, row["block"], pack_sorted(part(b.vocabulary, u, g)), pack_sorted(part(b.pairs, p, g)), *[pack(part(x, at, g)) for x, at in zip(counts, (u, u, p, p), strict=True)]) for g in range(groups)]
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[at : at + 64], strict=True), [pa.int64()] * 2 + [pa.binary()] * 6, strict=True)], ["g", "block", "words", "pairs", *_COUNTS])

    return run


def _totals(keys: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each entry's place among all distinct keys, and the sums by key."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return place, [np.bincount(place, np.concatenate(c), len(distinct)).astype(np.int64) for c in counts]


def _reduce(table: pa.Table) -> pa.Table:
    """Answers one reducer's requests. Row -1 tells its share of N and V."""
    release()
    column = lambda name, f: [f(x.as_py()) for x in table.column(name)]
    block, g = table.column("block").to_pylist(), table.column("g")[0].as_py()
    w, p = column("words", unpack_sorted), column("pairs", unpack_sorted)
    wp, (core, fold) = _totals(w, [column("core", unpack), column("fold", unpack)])
    pp, (pair, pair_fold) = _totals(p, [column("pair", unpack), column("pair_fold", unpack)])
    wend, pend = np.cumsum([len(x) for x in w]), np.cumsum([len(x) for x in p])
    rows = []
    for i, b in enumerate(block):
        mine, its = wp[wend[i] - len(w[i]) : wend[i]], pp[pend[i] - len(p[i]) : pend[i]]
        rows.append((g, b, pack(core[mine]), pack(fold[mine]), pack(pair[its]), pack(pair_fold[its]), 0, 0, 0))
    rows.append((g, -1, b"", b"", b"", b"", int(core.sum() + fold.sum()), int(np.count_nonzero(core + fold)), int(core.sum())))
    return pa.table([pa.array(x, pa.binary() if k in _COUNTS else pa.int64()) for k, x in zip(_REPLY_NAMES, zip(*rows, strict=True), strict=True)], _REPLY_NAMES)


_REPLY = "g long, block long, core binary, fold binary, pair binary, pair_fold binary, n long, v long, n_core long"
_REPLY_NAMES = [x.split()[0] for x in _REPLY.split(", ")]
_COUNTED = "docs binary, folds binary, lengths binary, core binary, fold binary, pair binary, pair_fold binary"


def _count(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block and its replies: per token c(w) and c(v w), without the fold and in it."""
    release()
    row = left.to_pylist()[0]
    b = Block(row)
    replies = right.sort_by("g")
    out = [row["docs"], row["folds"], row["lengths"]]
    for name, at in zip(_COUNTS, (b.tokens, b.tokens, b.pair, b.pair), strict=True):
        out.append(pack(np.concatenate([unpack(x.as_py()) for x in replies.column(name)])[at]))
    return pa.table([pa.array([x], pa.binary()) for x in out], [x.split()[0] for x in _COUNTED.split(", ")])


def _opened(batches, at_start: int, whole: bool):
    """Per block: ids, folds, lengths, and counts of the word, its context and the pair; of all training documents or without the fold."""
    for batch in batches:
        for row in range(batch.num_rows):
            release()
            column = lambda name: unpack(batch.column(name)[row].as_buffer()).astype(np.int64)  # noqa: B023, E731
            lengths, uni, pair = column("lengths"), column("core"), column("pair")
            if whole:
                uni += column("fold")
                pair += column("pair_fold")
            context = np.concatenate([[0], uni[:-1]])
            context[np.cumsum(lengths) - lengths] = at_start
            yield column("docs"), column("folds").astype(np.int8), lengths, uni, context, pair


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the binary logarithm of its frequency."""
    return np.frexp(context.astype(float))[1]


def _exact_sums(values: np.ndarray, place: np.ndarray, n: int) -> list[Decimal]:
    """Sums of whole numbers of up to 40 bits by place; in two halves, so that no sum of a block rounds."""
    high, low = (np.bincount(place, x, n).tolist() for x in (values >> 20, values & ((1 << 20) - 1)))
    return [Decimal((int(h) << 20) + int(x)) for h, x in zip(high, low, strict=True)]


def learn(cells: list[tuple], rounds: int = 200) -> dict[int, tuple[float, float, float]]:
    """EM over cells (bucket, f(w|v), f(w), floor, tokens): each bucket's weights (l2, l1, l0)."""
    out = {}
    for name in sorted({c[0] for c in cells}):
        f, n = np.array([c[1:4] for c in cells if c[0] == name]), np.array([c[4] for c in cells if c[0] == name], float)
        l = np.array([0.0, 0.5, 0.5] if name == 0 else [1 / 3] * 3)  # noqa: E741 - an unseen context has no followers
        for _ in range(rounds):
            share = f * l
            share *= (n / share.sum(1))[:, None]
            l = np.maximum(share.sum(0) / n.sum(), [0.0 if name == 0 else 1e-6, 1e-6, 1e-6])  # noqa: E741
            l /= l.sum()  # noqa: E741
        out[name] = tuple(l.tolist())
    return out


def weight_table(weights: dict[int, tuple]) -> np.ndarray:
    """Weights by bucket; one that the fold lacks takes the nearest lower one's, at first those of an unseen context."""
    table = np.zeros((66, 3))
    table[0] = weights.get(0, (0.0, 0.5, 0.5))
    for k in range(1, 66):
        table[k] = weights.get(k, table[k - 1])
    return table


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Folds by r = crc32(doc_id as text) mod 10: 0 is held out, 1 is the fold that sets the weights; both
    base_score and score then count 1 to 9.
    """
    r = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 10
    fold = F.when(r == 0, HELD_OUT).when(r == 1, FOLD).when(r.isNull(), CORE | NO_ID).otherwise(CORE).cast("int")
    src = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(0)).alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), fold.alias("fold"))
    blocks = written(src.mapInArrow(_blocks, _BLOCK), "lm-blocks")
    told = blocks.agg(F.sum("n_entries").alias("entries"), F.count("*").alias("blocks")).first()
    entries, parts = told.entries or 0, max(1, told.blocks)
    groups = max(1, math.ceil(entries / GROUP_ENTRIES), blocks.sparkSession.sparkContext.defaultParallelism if entries > 1 << 20 else 1)
    asked = blocks.mapInArrow(_requests(groups), "g long, block long, words binary, pairs binary, core binary, fold binary, pair binary, pair_fold binary")
    replies = asked.repartition(groups, "g").groupBy("g").applyInArrow(_reduce, _REPLY)
    replies = written(replies, "lm-replies")
    told = replies.filter("block = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("n_core").alias("n_core")).first()
    n_all, v_all, n_core = (int(told[k] or 0) for k in ("n", "v", "n_core"))
    told = src.agg(F.count_if(F.col("fold").isin(CORE, CORE | NO_ID)).alias("core"), F.count_if(F.col("fold") == FOLD).alias("fold")).first()
    counted = written(blocks.repartition(parts, "block").groupBy("block").cogroup(replies.filter("block >= 0").repartition(parts, "block").groupBy("block")).applyInArrow(_count, _COUNTED), "lm-counts")
    remove(replies)
    remove(blocks)

    def statistics(batches):
        for _, folds, lengths, *counts in _opened(batches, told.core, False):
            use = np.repeat(folds & 3 == FOLD, lengths)
            c1, cv, c2 = (x[use] for x in counts)
            f2, f1 = c2 / np.maximum(cv, 1), c1 / max(n_core, 1)
            q = lambda f: np.where(f > 0, 1 - np.round(STEPS * np.log2(np.where(f > 0, f, 1))), 0).astype(np.int64)
            cell, place, n = np.unique((bucket(cv).astype(np.int64) << 32) + (q(f2) << 16) + q(f1), return_inverse=True, return_counts=True)
            sums = [_exact_sums(np.round(f * UNIT).astype(np.int64), place, len(cell)) for f in (f2, f1)]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n), *[pa.array(x, pa.decimal128(38, 0)) for x in sums]], ["cell", "n", "s2", "s1"])

    # few cells: buckets and rounded logarithms, not n-grams
    cells = counted.mapInArrow(statistics, "cell long, n long, s2 decimal(38,0), s1 decimal(38,0)").groupBy("cell").agg(*[F.sum(k).alias(k) for k in ("n", "s2", "s1")]).orderBy("cell").collect()
    table = weight_table(learn([(x.cell >> 32, float(x.s2) / UNIT / x.n, float(x.s1) / UNIT / x.n, 1 / (v_all + 1), x.n) for x in cells]))

    def scores(batches):
        for ids, folds, lengths, uni, context, pair in _opened(batches, told.core + told.fold, True):
            doc = np.repeat(np.arange(len(ids)), lengths)
            at = bucket(context)
            p = table[at, 0] * pair / np.maximum(context, 1) + table[at, 1] * uni / max(n_all, 1) + table[at, 2] / (v_all + 1)
            add = lambda x: np.bincount(doc, x, len(ids))
            base = add(np.log10((uni + 0.1) / (n_all + 0.1 * (v_all + 1))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=folds & NO_ID > 0), pa.array(folds == HELD_OUT), pa.array(lengths), pa.array(add(uni > 0).astype(np.int64)), pa.array(np.full(len(ids), n_all)), pa.array(base), pa.array(add(np.log10(p)))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The same by dictionaries, for tests; the weights are learned on exact probabilities."""
    import re
    import zlib
    from collections import Counter

    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    rows = [(d, 2 if d is None else zlib.crc32(str(d).encode()) % 10, split(t)) for d, t in docs]
    bits = lambda c: int(c).bit_length()

    def counted(least):
        uni, pair = Counter(), Counter()
        for _, r, x in rows:
            if r >= least:
                uni.update([*x, "<s>"])
                pair.update(zip(["<s>", *x], x, strict=False))
        n = sum(c for w, c in uni.items() if w != "<s>")
        return uni, n, lambda a, b: (uni[a], pair[a, b] / uni[a] if uni[a] else 0.0, uni[b] / max(n, 1))

    known, n, now = counted(1)
    v, meanwhile = len(known) - ("<s>" in known), counted(2)[2]
    cells = [(bits(c), f2, f1, 1 / (v + 1), 1) for _, r, x in rows if r == 1 for c, f2, f1 in (meanwhile(a, b) for a, b in zip(["<s>", *x], x, strict=False))]
    table, out = weight_table(learn(cells)), []
    for d, r, x in rows:
        s = sum(math.log10(table[bits(c)] @ (f2, f1, 1 / (v + 1))) for c, f2, f1 in (now(a, b) for a, b in zip(["<s>", *x], x, strict=False)))
        out.append((d, r == 0, len(x), sum(known[w] > 0 for w in x), n, sum(math.log10((known[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), s))
    return out
