"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of 3 and of 4 bytes of the text after A-Z became a-z and every ASCII character that
isn't a letter became a blank; a run hashes to one of ``BUCKETS`` embeddings of ``DIM`` numbers. A text's
vector is the mean of its runs' embeddings; logits are linear in it. Both are trained by stochastic
gradient descent in numpy on a bounded sample: about ``PER_LANGUAGE`` rows of each language, fewer where there are more
than ROWS / PER_LANGUAGE languages or where their bags (at most 8 bytes for each run, and for each bucket) would take
more than ``SAMPLE_BYTES``. Rows are taken by a hash of the id. Part of the sample sets the softmax's temperature and
the confidence below which a prediction is marked as rejected (so that those above are right in ``RIGHT`` of cases).

For prediction with at most DIM languages the two linear maps are one table (buckets by languages); with more the
embeddings are averaged first, so a model of any number of languages has about the embeddings' size. There is no shuffle,
and the model is the only broadcast. No language is left out; the driver sees one row per language.

Null text and text without a letter: `und`, score 0, rejected. Null languages aren't learned from;
without any, everything is `und`. Ties go to the language that is first in code-point order. Repeated
rows are predicted alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.util import CHUNK, LOWER, pieces, raw

BITS, DIM, LENGTHS = 15, 16, (3, 4)
BUCKETS = 1 << BITS
PER_LANGUAGE, ROWS, SAMPLE_BYTES, EPOCHS, RIGHT = 1_000, 20_000, 128 << 20, 6, 0.99
UNKNOWN = "und"
_LETTERS = LOWER.copy()
_LETTERS[:128][~np.array([chr(b).isalpha() for b in range(128)])] = 32
_LETTER = re.compile(r"[^\W\d_]")


def runs(data: np.ndarray, offsets: np.ndarray):
    """Yields (row, bucket) arrays of all subwords, part by part of the buffer, each with its neighbours' bytes."""
    base, stop = int(offsets[0]), int(offsets[-1])
    for at in range(base, stop, CHUNK):
        end = min(stop, at + CHUNK)
        b = _LETTERS[data[at : min(stop, end + max(LENGTHS) - 1)]].astype(np.uint32)
        for n in LENGTHS:
            m = min(end, stop - n + 1) - at
            if m <= 0:
                continue
            code = b[:m].copy()
            for i in range(1, n):
                code = code << np.uint32(8) | b[i : i + m]
            code = (code * np.uint32(0x9E3779B1 + 2 * n)) ^ (code >> np.uint32(15))
            bucket = (code * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
            first = np.searchsorted(offsets, np.arange(at, at + 1), "right")[0] - 1
            last = np.searchsorted(offsets, at + m - 1, "right") - 1
            lo, hi = np.maximum(offsets[first : last + 1], at), np.minimum(offsets[first + 1 : last + 2] - (n - 1), at + m)
            some = hi > lo
            yield np.arange(first, last + 1)[some], lo[some] - at, hi[some] - at, bucket


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS by DIM or, where ``out`` is None, by languages: each bucket's share of the logits
    out: np.ndarray | None  # DIM by languages
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability, and whether the prediction is to be trusted."""
        data, offsets = raw(column)
        k, n_rows = len(self.languages), len(offsets) - 1
        total, n = np.zeros((n_rows, self.table.shape[1])), np.zeros(n_rows)
        for row, lo, hi, bucket in runs(data, offsets):
            if not len(row):
                continue
            values = self.table[bucket]
            cut = np.stack([lo, np.minimum(hi, len(bucket))], 1).ravel()
            tail = cut[-1] == len(bucket)
            total[row] += np.add.reduceat(values, cut[:-1] if tail else cut, axis=0)[::2]
            n[row] += hi - lo
        mean = total / np.maximum(n, 1)[:, None]
        z = ((mean if self.out is None else mean @ self.out) + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True)) if k else np.zeros((n_rows, 1))
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        best = p.argmax(1)
        known = np.array([bool(k and t.is_valid and _LETTER.search(t.as_py())) for t in column], bool)
        top = np.where(known, p[np.arange(n_rows), best], 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)], top, known & (top >= self.least)


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """bags: (buckets, counts) of each text. A fifth of them only calibrates."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    check, learn = order[: len(order) // 5], order[len(order) // 5 :]
    e = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    w, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            rate = 2.0 * (1 - done / steps)
            done += 1
            buckets, share = bags[i]
            if not len(buckets):
                continue
            x = share @ e[buckets]
            z = x @ w + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            back = w @ g
            w -= rate * np.outer(x, g)
            bias -= 0.05 * rate * g
            e[buckets] -= rate * share[:, None] * back * 8
    one = len(languages) <= DIM
    model = Model(languages, (e @ w).astype(np.float32) if one else e, None if one else w, bias)
    if len(check):
        z = np.array([bags[i][1] @ e[bags[i][0]] @ w + bias if len(bags[i][0]) else bias for i in check], float)

        def loss(t):
            s = z / t
            return -(s[np.arange(len(z)), y[check]] - s.max(1) - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1))).mean()

        model.temperature = float(min((2.0**k for k in np.arange(-4, 6, 0.25)), key=loss))
        s = z / model.temperature
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        top, right = p.max(1), p.argmax(1) == y[check]
        order = np.argsort(-top, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) >= RIGHT * np.arange(1, len(order) + 1))
        model.least = float(top[order[good[-1]]]) if len(good) else 1.0
    return model


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """From all rows of ``docs`` with a text and a language, by a sample."""
    rows = docs.select(F.col("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    bag_bytes = F.least(F.octet_length("text").cast("long") * 16, F.lit(8 * BUCKETS).cast("long"))
    sizes = {r.lang: (r.n, r.b) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(bag_bytes).alias("b")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), None, np.zeros(0, np.float32))
    unit, most = 1 << 30, min(per_language, max(1, ROWS // len(sizes)))
    share = lambda n, b: int(min(1, most / n, SAMPLE_BYTES / len(sizes) / max(1, b)) * unit)
    parts = docs.sparkSession.createDataFrame([(k, share(*x)) for k, x in sizes.items()], "lang string, _part long")
    rows = rows.join(F.broadcast(parts), "lang")  # one row per language
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(unit)) < F.col("_part")).select("lang", "text")

    def bag(batches):
        for batch in pieces(batches):
            data, offsets = raw(batch.column(1))
            found = [[] for _ in range(batch.num_rows)]
            for row, lo, hi, bucket in runs(data, offsets):
                for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    found[r].append(bucket[a:b])
            out = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint32), np.zeros(0, int)) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.astype("<u4").tobytes() for a, _ in out], pa.binary()), pa.array([(n / max(1, n.sum())).astype("<f4").tobytes() for _, n in out], pa.binary())], ["lang", "buckets", "shares"])

    languages = sorted(sizes)
    number = {k: i for i, k in enumerate(languages)}
    got = sorted(picked.mapInArrow(bag, "lang string, buckets binary, shares binary").collect())  # about SAMPLE_BYTES
    y = np.array([number[r.lang] for r in got], int)
    return train([(np.frombuffer(r.buckets, "<u4"), np.frombuffer(r.shares, "<f4")) for r in got], y, languages)


def predicted(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("read"))

    def run(batches):
        for batch in pieces(batches):
            lang, score, sure = shared.value.predict(batch.column(1))
            out = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(sure)], ["lang_pred", "score", "accepted"])
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["row", "found"])

    from pyspark.sql import types as T

    schema = T.StructType([src.schema["row"], T.StructField("found", T._parse_datatype_string("struct<lang_pred: string, score: double, accepted: boolean>"))])
    return src.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in keep], "found.*")


def held_out(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted."""
    model = learn(docs.filter(~held_out()))
    return predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
