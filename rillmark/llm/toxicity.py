"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton in folded text.

Folding lowers case, drops invisible characters, maps homoglyphs (Cyrillic, Greek, full-width and
mathematical letters) to Latin ones, digits and signs that stand for letters to these, and ``l`` to ``i``
(so that ``1`` may be either). A lexicon entry counts where no letter or digit touches it, and not within
an exception phrase. A text's features are its matched weight, that weight by its length in words, and
its length; a logistic curve fitted to the labels turns them into a score.

The lexicon, its weights and the curve are learned from at most about ``SAMPLE`` labelled rows per class
(taken by a hash of the id; the classes' shares are restored by weights), with near copies thinned to the row of the
least id for each least hash of five-word runs. The ids of the sample are the only rows that are broadcast. Of the
words, those that pass the support and odds thresholds reach the driver, all of them: since each is in ``SUPPORT`` of
the toxic sample, there are at most 1 / SUPPORT times as many as a toxic row has different words on average.

Scoring is one pass without a shuffle. Null and empty texts have no match and get the curve's value for
that. Several labels of a row count as their greatest; null labels are not used. Without usable labels
the built-in seed entries and curve are used. Entries that fold alike are one, with the greater weight. Ids that are
learned from are whole numbers; repeated rows are scored alike. Other columns stay; one that is called like the
result is replaced by it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm.near_dedup import kmers
from rillmark.llm.util import PLAIN_WORDS, pieces, words, written

SAMPLE = 10_000
#: A lexicon word is in at least this share of the toxic sample, and this many times as frequent as in the rest.
SUPPORT, ODDS = 0.01, 6.0

# Latin letters that the characters above them look like or stand for.
LOOKS = {
    "авекмнорстухѕіјһԁԛԝ": "abekmhopctyxsijhdqw",
    "αβεικνορτυχ": "abeikvoptux",
    "0134578": "oieastb",
}
#: Signs that stand for letters only within a word.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
#: Phrases in which an entry is not meant badly.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "stupid question", "idiot proof", "scum line")
#: Entries for use without labels, with their weights.
SEEDS = {"idiot": 3.0, "moron": 3.0, "scum": 3.0, "stupid": 2.0, "loser": 2.0, "worthless": 2.0, "pathetic": 2.0, "disgusting": 2.0, "trash": 1.5, "clown": 1.5}

_MAP = {ord(a): b for x, y in LOOKS.items() for a, b in zip(x, y, strict=True)}
_MAP |= {ord("l"): "i"} | dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_WIDE = re.compile("[！-～\U0001d400-\U0001d7ff]")
_SIGN = re.compile(r"(?<![^\W_])[@$](?=[a-z])|(?<=[a-z])[@$!|]+(?=[a-z])")


def fold(text: str) -> str:
    if _WIDE.search(text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(_MAP)
    return _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text) if any(s in text for s in SIGNS) else text


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-3.0, 2.0, 0.5, 0.0)
    _machine: object = field(default=None, repr=False)

    def machine(self):
        import ahocorasick

        if self._machine is None:
            a, entries = ahocorasick.Automaton(), {}
            for w, x in self.weights.items():
                entries[fold(w)] = max(x, entries.get(fold(w), x))
            for w, x in (entries | {fold(phrase): None for phrase in self.exceptions}).items():
                a.add_word(w, (len(w), x))
            a.make_automaton()
            self._machine = a
        return self._machine

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_machine": None}

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries that stand alone and in no exception phrase."""
        if not (self.weights or self.exceptions):
            return []
        found, spared = [], []
        for last, (n, x) in self.machine().iter(folded):
            a, b = last - n + 1, last + 1
            if (a and folded[a - 1].isalnum()) or (b < len(folded) and folded[b].isalnum()):
                continue
            (spared if x is None else found).append((a, b, x))
        if not spared:
            return found
        spared.sort()
        starts, reach = [a for a, _, _ in spared], list(accumulate((b for _, b, _ in spared), max))
        return [m for m in found if not (k := bisect_right(starts, m[0])) or reach[k - 1] < m[1]]

    def score(self, total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        z = features(total, n_words) @ np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    n = np.maximum(n_words, 1)
    return np.stack([np.ones(len(total)), np.log1p(np.maximum(total, 0)), np.log1p(100 * np.maximum(total, 0) / n), np.log(n) / 5], 1)


def fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(h, x.T @ (w * (y - p)) - 1e-2 * beta)
    return beta


def _measured(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    n = words(column, PLAIN_WORDS).counts()
    found = [model.matches(fold(t)) if t else [] for t in column.to_pylist()]
    return np.array([sum(x for _, _, x in m) for m in found], float), n, found


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS, sample: int = SAMPLE) -> Model:
    """docs: doc_id and text of rows that may be learned from; labels: doc_id and a 0/1 column."""
    spark = docs.sparkSession
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    size = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Model(dict(SEEDS), exceptions)
    unit = 1 << 30
    part = F.when(F.col("y") == 1, int(min(1, sample / size[1]) * unit)).otherwise(int(min(1, sample / size[0]) * unit))
    picked = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(unit)) < part)  # about 2 * sample ids at most

    def opened(batches):
        for batch in pieces(batches):
            w = words(batch.column(1), PLAIN_WORDS)
            x, to = kmers(w.hash, w.bounds())
            least = [int(x[a:b].min() >> np.uint64(1)) if b > a else 0 for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["doc_id", "text", "y", "least"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")
    rows = written(texts.mapInArrow(opened, "doc_id long, text string, y int, least long").groupBy("least", "y").agg(F.min(F.struct("doc_id", "text")).alias("r")).select("r.doc_id", "r.text", "y"), "toxicity-sample")
    seen = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return Model(dict(SEEDS), exceptions)

    def spoken(batches):
        for batch in pieces(batches):
            out = [(w, y) for t, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) for w in set(re.findall(r"[^\W\d_]{2,}", fold(t)))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], ["word", "y"])

    counts = rows.mapInArrow(spoken, "word string, y int").groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    odds = rate("bad", seen[1]) / rate("good", seen[0])
    least = max(4, SUPPORT * seen[1])
    kept = counts.filter((F.col("bad") >= least) & (odds >= ODDS)).select("word", F.log(odds).alias("weight")).orderBy("word").collect()
    model = Model({r.word: r.weight for r in kept}, exceptions)

    def measured(batches):
        for batch in pieces(batches):
            total, n, _ = _measured(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(n.astype(np.int64)), batch.column(2)], ["total", "n", "y"])

    seen_rows = rows.mapInArrow(measured, "total double, n long, y int").collect()
    x = features(*(np.array([r[i] for r in seen_rows], float) for i in (0, 1)))
    y = np.array([r.y for r in seen_rows], float)
    model.curve = tuple(fitted(x, y, np.where(y > 0, size[1] / seen[1], size[0] / seen[0])).tolist())
    return model


def _scored(docs: DataFrame, model: Model, keep: list[str], text: str, spans: bool) -> DataFrame:
    """(row, toxicity): the kept columns as one, and score and matches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size doesn't grow with the documents
    shape = "struct<score: double, matches: array<struct<start: int, end: int, weight: double>>>"
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("scored"))

    def run(batches):
        for batch in pieces(batches):
            total, n, found = _measured(shared.value, batch.column(1))
            spans_ = [[{"start": a, "end": b, "weight": x} for a, b, x in m] if spans else [] for m in found]
            out = pa.StructArray.from_arrays([pa.array(shared.value.score(total, n)), pa.array(spans_, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())])))], ["score", "matches"])
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["row", "toxicity"])

    return src.mapInArrow(run, T.StructType([src.schema["row"], T.StructField("toxicity", T._parse_datatype_string(shape))]))


def scored(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """Adds ``toxicity``: the score, and the matches' spans and weights in the folded text (empty where spans is off)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "toxicity"]
    return _scored(docs, model, keep, text, spans).select(*[F.col("row").getField(c).alias(c) for c in keep], "toxicity")


def held_out(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def model_for(docs: DataFrame, labels: DataFrame) -> Model:
    """Learned from the rows that aren't held out."""
    return learn(docs, labels.filter(~held_out()))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    s = F.col("toxicity.score")
    return scored(docs, model_for(docs, labels), keep=["doc_id"], spans=False).select("doc_id", held_out().alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold."""
    kept = _scored(docs, model, docs.columns, "text", False).filter(F.col("toxicity.score") < threshold)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def brute_force(model: Model, text: str | None) -> float:
    """A text's score by looking for every entry in turn, for tests."""
    folded = fold(text or "")

    def places(phrase):
        at = folded.find(phrase)
        while at >= 0:
            if not (at and folded[at - 1].isalnum()) and not (at + len(phrase) < len(folded) and folded[at + len(phrase)].isalnum()):
                yield at, at + len(phrase)
            at = folded.find(phrase, at + 1)

    spared = [p for e in model.exceptions for p in places(fold(e))]
    entries = {f: max(x for w, x in model.weights.items() if fold(w) == f) for f in {fold(w) for w in model.weights}}
    entries = {w: x for w, x in entries.items() if w not in {fold(e) for e in model.exceptions}}
    total = math.fsum(x for w, x in entries.items() for a, b in places(w) if not any(c <= a and b <= d for c, d in spared))
    n = len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
    return float(model.score(np.array([total]), np.array([n]))[0])
