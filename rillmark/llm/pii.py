"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base entities (email, ip, card, phone) come from regular expressions and checks. They are the seeds: a
seed and the words before it induce lexical patterns: a kind, and the word one or two places to the left.
Patterns and the identifiers (instances) found beside them form a graph, and scores go back and forth:

    score(instance) = 1 for a seed, else 1 - product over its patterns p of (1 - conf(p))
    conf(pattern)   = sum over its instances of score * occurrences / occurrences of its word in all texts

so that a word which mostly has other things behind it (an article, say) is no pattern. Only patterns with at least ``SUPPORT`` distinct seeds count. After ``ROUNDS`` rounds, patterns
with a confidence of at least ``CONFIDENCE`` are kept, all of them, and every candidate beside
one, of a shape that its kind may have, is a new span unless it overlaps a base one.

At scale: texts are read by regular expressions whose time is in proportion to the text (possessive
or anchored, so Java neither backtracks nor recurses over long runs); what is found is written without
the texts; a second reading counts words, summed per task before the shuffle. A text with n matches takes about
n ** 1.5 small steps: places and overlaps are looked up in blocks of about the square root of n. The graph has only tokens
with a digit or an ``@``. It is grouped by pattern or instance after counting each (pattern, instance) once, so a
frequent one is a number, not a group; joins deal a frequent context's or instance's rows over many tasks. Patterns stay a
table, and no pattern reaches the driver.

Null text is empty text. Repeated rows are each reported. An empty table gives an empty result. Only ids and texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.util import spread_join, written

KINDS = ("email", "ip", "card", "phone")
SUPPORT, ROUNDS, CONFIDENCE = 5, 3, 0.8

# Java forms of the base expressions. They match what the plain forms match; the guards
# before them only keep the search from starting within a run that has failed already.
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A token with a digit or an @, and the number-like tokens that follow it.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\sA-Za-z0-9]*+[0-9][^\sA-Za-z]*+(?!\S))*+"
#: What a candidate may be, by its text without marks around it.
SHAPES = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}$",
    "card": r"^(?:[0-9][ -]?){11,18}[0-9]$",
    "phone": r"^\+?[(]?(?:[0-9][ ().-]{0,2}){6,14}[0-9]$",
}
#: The least number of matches that are summed up together.
_STEP = 64


def let(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _step(n: Column) -> Column:
    return F.greatest(F.lit(_STEP), F.floor(F.sqrt(n)).cast("int"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, F.floor(digit(i) * 2 / 10).cast("int") + digit(i) * 2 % 10).otherwise(digit(i))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])?(?:\.|$)){4}$") & ~m.rlike(r"(?:^|\.)0*+(?:[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]|[1-9][0-9]{3,})")
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _placed(m: Column, g: Column, e: Column, b: Column) -> Column:
    """Matches, gaps, lengths of both and the sums before each step: the matches with their places."""

    def place(x, i):
        size = _step(F.size(e))
        step = F.floor(i / size).cast("int")
        end = F.get(b, step) + F.aggregate(F.slice(e, step * size + 1, i - step * size + 1), F.lit(0), lambda a, n: a + n)
        return F.struct(x.alias("match"), (end - F.length(x)).alias("start"), end.alias("end"), F.get(g, i).alias("before"))

    return F.transform(m, place)


def _as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _of_kind(spans: str, kind: int) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def located(df: DataFrame, text: str, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds for each (name: expression, guard) an array of (match, start, end, words before): leftmost, non-overlapping, in code points.

    The pieces between matches give the places; their running sums are taken in steps so that a text with very many
    matches isn't summed from its start for each.
    """
    t = F.col(text)
    out = df
    for name, (expression, guard) in wanted.items():
        none = F.array().cast("array<string>")
        out = out.withColumn(f"_m_{name}", F.when(guard, F.regexp_extract_all(t, F.lit(expression), F.lit(0))).otherwise(none))
    for name, (expression, _) in wanted.items():
        out = out.withColumn(f"_g_{name}", F.when(F.size(f"_m_{name}") > 0, F.split(t, expression, -1)).otherwise(F.array().cast("array<string>")))
    for name in wanted:
        m, g = F.col(f"_m_{name}"), F.col(f"_g_{name}")
        out = out.withColumn(f"_e_{name}", F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda x, y: F.length(x) + F.length(y)))
    for name in wanted:
        e = F.col(f"_e_{name}")
        out = out.withColumn(f"_b_{name}", F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(e), F.lit(1)) - 1) / _step(F.size(e))).cast("int")), lambda c: F.aggregate(F.slice(e, F.lit(1), c * _step(F.size(e))), F.lit(0), lambda a, x: a + x)))
    for name in wanted:
        out = out.withColumn(name, _placed(*(F.col(f"_{k}_{name}") for k in "mgeb")))
    return out.drop(*[f"_{k}_{name}" for name in wanted for k in "mgeb"])


def _contexts(before: Column) -> Column:
    """The word one and the word two places before, in lower case, each after its number; null where a digit or the text's start comes first."""
    word = lambda w, n: F.get(w, F.size(w) - n)
    letters = lambda w, n: word(w, n).rlike(r"^\p{L}")
    first = lambda w: F.when(letters(w, 1), F.concat(F.lit("1 "), F.lower(word(w, 1))))
    second = lambda w: F.when(letters(w, 1) & letters(w, 2), F.concat(F.lit("2 "), F.lower(word(w, 2))))
    return let(F.regexp_extract_all(before, F.lit(r"\p{L}++|\p{N}++"), F.lit(0)), lambda w: F.array(first(w), second(w)))


def _in_blocks(spans: Column) -> Column:
    """Spans in blocks of about the square root of their number, with each block's least start and greatest end."""
    size = _step(F.size(spans))
    part = lambda c: F.slice(spans, c * size + 1, size)
    block = lambda x: F.struct(F.array_min(F.transform(x, lambda b: b["start"])).alias("lo"), F.array_max(F.transform(x, lambda b: b["end"])).alias("hi"), x.alias("spans"))
    return F.when(F.size(spans) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(spans), F.lit(1)) - 1) / size).cast("int")), lambda c: let(part(c), block)))


def extracted(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, base (kind, start, end) in order, candidates (instance, start, end, seed kinds, possible kinds, contexts)."""
    t = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    some = F.col("_t").rlike("[0-9@]")
    guards = {"email": F.col("_t").contains("@"), "ip": some, "card": some, "phone": F.col("_t").contains("+")}
    found = located(t, "_t", {f"f_{k}": (EXPRESSIONS[k], guards[k]) for k in KINDS} | {"f_any": (CANDIDATE, some)})
    checked = lambda k: F.filter(f"f_{k}", lambda x: valid(k, x["match"]))
    found = found.withColumn("base", F.concat(*[_as_spans(checked(k), i) for i, k in enumerate(KINDS)])).drop(*[f"f_{k}" for k in KINDS])

    def candidate(x, blocks):
        lead = F.length(F.regexp_extract(x["match"], r"^[^\p{L}\p{N}+(@]*+", 0))
        core = F.regexp_replace(x["match"], r"^[^\p{L}\p{N}+(@]++|[^\p{L}\p{N})]++$", "")
        return let(F.struct(core.alias("core"), (x["start"] + lead).alias("start"), (x["start"] + lead + F.length(core)).alias("stop")), lambda at: placed(x, blocks, at["core"], at["start"], at["stop"]))

    def placed(x, blocks, core, start, stop):
        near = F.flatten(F.transform(F.filter(F.coalesce(blocks, F.array()), lambda b: (b["lo"] < stop) & (b["hi"] > start)), lambda b: b["spans"]))
        overlap = F.filter(near, lambda b: (b["start"] < stop) & (b["end"] > start))
        return F.struct(core.alias("instance"), start.alias("start"), stop.alias("end"), F.array_distinct(F.transform(overlap, lambda b: b["kind"])).alias("seeds"), F.filter(F.array(*[F.when(core.rlike(SHAPES[k]), F.lit(i)) for i, k in enumerate(KINDS)]), lambda v: v.isNotNull()).alias("kinds"), _contexts(x["before"]).alias("contexts"))

    return found.select(*keep, "base", let(_in_blocks(F.col("base")), lambda blocks: F.transform("f_any", lambda x: candidate(x, blocks))).alias("candidates"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all lower-cased runs of letters, pre-aggregated where they are read."""
    return docs.select(F.explode(F.split(F.lower(F.col(text).cast("string")), r"[^\p{L}]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def learned(found: DataFrame, words: DataFrame, *, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(kind, context, confidence, seeds) of all patterns with enough seeds, by the pattern-instance graph of ``extracted``."""
    c = found.select(F.explode("candidates").alias("c")).select("c.*")
    # a seed stands for its own kind, another candidate for each kind that its shape allows
    c = c.select("instance", "contexts", F.explode(F.when(F.size("seeds") > 0, F.col("seeds")).otherwise(F.col("kinds"))).alias("kind"), (F.size("seeds") > 0).alias("seed"))
    edges = c.select("kind", "instance", "seed", F.explode("contexts").alias("context")).filter("context is not null").groupBy("kind", "context", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = written(edges, "pii-edges")
    enough = edges.groupBy("kind", "context").agg(F.count_if("seed").alias("seeds")).filter(F.col("seeds") >= support).withColumn("word", F.substring("context", 3, 1000))
    enough = written(enough, "pii-contexts")
    uses = words.join(enough.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("uses"))
    edges = written(spread_join(edges, enough.join(uses, "word").drop("word"), ["kind", "context"], ["instance"]), "pii-graph")
    instances = edges.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for i in range(rounds):
        patterns = spread_join(edges, instances, ["kind", "instance"], ["context"]).groupBy("kind", "context", "seeds", "uses").agg((F.sum(F.col("score") * F.col("n")) / F.greatest(F.col("uses"), F.sum("n"))).alias("confidence"))
        if i + 1 < rounds:
            doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))
            patterns = written(patterns.select("kind", "context", "confidence"), "pii-confidence")
            instances = written(spread_join(edges.select("kind", "context", "instance", "seed"), patterns, ["kind", "context"], ["instance"]).groupBy("kind", "instance").agg(F.when(F.max("seed"), F.lit(1.0)).otherwise(1 - doubt).alias("score")), "pii-scores")
    return patterns


def _added(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(_at, added): the candidates that aren't seeds and stand beside a pattern of a kind that they may be."""
    kinds = written(patterns.groupBy("context").agg(F.collect_set("kind").alias("_kinds")), "pii-patterns")
    c = found.select("_at", F.explode(F.filter("candidates", lambda x: (F.size(x["seeds"]) == 0) & (F.size(x["kinds"]) > 0))).alias("c"))
    c = c.select("_at", "c.start", "c.end", "c.kinds", F.explode("c.contexts").alias("context")).filter("context is not null")
    beside = spread_join(c, kinds, ["context"], ["_at", "start"])
    spans_ = beside.select("_at", "start", "end", F.explode(F.array_intersect("kinds", "_kinds")).alias("kind"))
    return spans_.groupBy("_at").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))


def spans(docs: DataFrame, *, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, base, spans: arrays of (kind, start, end) by kind and place; spans has the base ones too."""
    found = written(extracted(docs, keep=keep).withColumn("_at", F.monotonically_increasing_id()), "pii-found")
    patterns = learned(found, word_counts(docs), support=support, rounds=rounds).filter(F.col("confidence") >= confidence)
    added = written(_added(found, patterns), "pii-added")
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return found.drop("candidates").join(added, "_at", "left").select(*keep, "base", F.array_sort(F.concat("base", F.coalesce("added", empty))).alias("spans"))


def joined(c: Column | str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans."""
    counts = [F.size(_of_kind("base", i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans(docs).select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def masked(docs: DataFrame, *, mark: str = "*") -> DataFrame:
    """The documents with every span's characters replaced. A text without a span stays as it is; of another, characters and places are put in order once."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    found = spans(keyed, keep=("_row",))
    t = F.col("_row.text").cast("string")
    hidden = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.length(t) - 1), hidden)
    char = lambda places, c: F.transform(places, lambda i: F.struct(i.alias("i"), c(i).alias("c")))
    shown = let(F.split(t, ""), lambda chars: char(left, lambda i: F.get(chars, i)))
    whole = F.array_join(F.transform(F.array_sort(F.concat(char(hidden, lambda i: F.lit(mark)), shown)), lambda x: x["c"]), "")
    out = F.when(F.size("spans") > 0, whole).otherwise(t)
    return found.select(*[out.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def brute_force(text: str | None) -> list[tuple[int, int, int]]:
    """The base spans by the plain expressions, for tests."""
    import re

    plain = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def ok(i, m):
        d = [int(c) for c in m if c.isdigit()]
        if i == 1:
            return all(int(p) <= 255 for p in m.split("."))
        if i == 2:
            return 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 // 10 + x * 2 % 10 for k, x in enumerate(reversed(d))) % 10 == 0
        return i != 3 or 8 <= len(d) <= 15

    return [(i, *m.span()) for i, p in enumerate(plain) for m in re.finditer(p, text or "") if ok(i, m[0])]
