"""URL filter: allow and block rules, and for other URLs a character language-model ratio.

Two variable-order Markov models, of URLs that a rule allows and of those that one blocks, are smoothed
from order to order: with ``n(c)`` the class's occurrences of the context c and c' the context without
its first character,

    p(x | c) = (n(c x) + STRENGTH * p(x | c')) / (n(c) + STRENGTH),   p(x | nothing) = (n(x) + 1) / (n + 256).

Contexts go up to ``ORDER - 1`` characters; all grams are kept, however rare. The score is the mean over characters of
log p(allowed) - log p(blocked); a URL is blocked below a threshold that is set so that of the distinct allowed URLs
kept out of training, ``LOST`` are lost.

DataFrame operations only. A URL is cut once into windows of ORDER characters, by array places, so the work is in
proportion to its length; a window's row carries a 128-bit digest of the URL, not its text. The model is applied to
distinct windows, and each distinct URL that no rule decides sums up its windows' ratios (in whole units, so that
reruns agree). The windows' table is broadcast while it has at most ``BROADCAST_ROWS`` rows; a larger one is joined, with
frequent windows dealt over many tasks. So are the pages with their scores, where one URL may be a third of all.

The rules see host and path; the model is trained on and scores all that stands behind ``://``, with query and
fragment (the host in lower case), and where there is no ``://`` the whole string. Null URLs, and such without ``://``, have an empty host and path and fit no rule;
the latter are scored as they are, a null URL as the empty string, 0. Without allowed or without blocked URLs all scores are 0 and nothing else is
blocked. Rules of equal length go by their text. Repeated rows are judged alike; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.util import spread_join, written

#: (verdict, host and path)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ORDER, STRENGTH, LOST = 5, 4.0, 0.05
#: Of the table of windows; a row is two short strings and a number in memory, about 100 bytes.
BROADCAST_ROWS = 400_000
UNIT = 1e9
_START = "\u0002"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule and ruling (null where no rule fits). The longest fitting rule wins."""
    host, path = host_and_path(F.col(url).cast("string"))
    out = pages.withColumns({"host": host, "path": path})
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        rule, ruling = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return out.withColumns({"rule": rule, "ruling": ruling})


def _text(url: Column) -> Column:
    """The URL as the model sees it: all but the scheme. Needs the column host."""
    at = F.locate("://", url)
    whole = F.concat(F.col("host"), F.substring(url, at + 3 + F.length("host"), F.length(url)))
    return F.coalesce(F.when(at > 0, whole).otherwise(url), F.lit(""))


def windows(t: Column) -> Column:
    """For each character the ORDER characters up to it; before the text stand start marks."""
    chars = F.concat(F.array_repeat(F.lit(_START), ORDER - 1), F.split(t, ""))
    # the inner function's argument is evaluated once, so a window costs ORDER array places
    cut = F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - ORDER), lambda i: F.concat(*[F.get(c, i + k) for k in range(ORDER)])))
    return F.when(t != "", F.get(cut, F.lit(0)))


def grams(texts: DataFrame, allowed: Column) -> DataFrame:
    """(gram, order, good, bad): occurrences of all grams of 1 to ORDER characters, in each class."""
    rows = texts.groupBy("t").agg(F.count_if(allowed).alias("g"), F.count_if(~allowed).alias("b")).select("g", "b", F.explode(windows(F.col("t"))).alias("gram"))
    longest = rows.groupBy("gram").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    order = F.explode(F.sequence(F.lit(1), F.lit(ORDER)))
    return longest.select("g", "b", "gram", order.alias("order")).groupBy(F.expr("right(gram, order)").alias("gram"), "order").agg(F.sum("g").alias("good"), F.sum("b").alias("bad"))


def cut(texts: DataFrame) -> DataFrame:
    """(key, n, window): a row per character of each distinct ``t``; one with a null window for an empty text."""
    one = texts.select("t").distinct().select(key(F.col("t")).alias("key"), F.length("t").alias("n"), windows(F.col("t")).alias("windows"))
    return one.select("key", "n", F.explode_outer("windows").alias("window"))  # the key is computed before, not per window


def key(t: Column) -> Column:
    return F.unhex(F.md5(t))


def ratios(wanted: DataFrame, counted: DataFrame) -> DataFrame:
    """(window, units) for distinct windows: log p(allowed) - log p(blocked) of the last character after the others."""
    contexts = counted.groupBy(F.expr("left(gram, order - 1)").alias("context"), "order").agg(F.sum("good").alias("cg"), F.sum("bad").alias("cb"))
    contexts = written(contexts, "url-contexts")
    whole = contexts.filter("order = 1").first()
    out, pg, pb = wanted, F.lit(1 / 256), F.lit(1 / 256)
    for k in range(1, ORDER + 1):
        gram = counted.filter(F.col("order") == k).select(F.col("gram").alias("_gram"), F.col("good").alias(f"g{k}"), F.col("bad").alias(f"b{k}"))
        out = out.join(gram, F.expr(f"right(window, {k})") == F.col("_gram"), "left").drop("_gram")
        if k > 1:
            context = contexts.filter(F.col("order") == k).select(F.col("context").alias("_context"), F.col("cg").alias(f"cg{k}"), F.col("cb").alias(f"cb{k}"))
            out = out.join(context, F.expr(f"left(right(window, {k}), {k - 1})") == F.col("_context"), "left").drop("_context")
        n = lambda c: F.coalesce(F.col(c), F.lit(0))
        if k == 1:
            out = out.withColumns({"pg": (n("g1") + 1) / (whole.cg + 256), "pb": (n("b1") + 1) / (whole.cb + 256)})
        else:
            out = out.withColumns({f"p{x}": (n(f"{x}{k}") + STRENGTH * F.col(f"p{x}")) / (n(f"c{x}{k}") + STRENGTH) for x in "gb"})
    return out.select("window", F.round((F.log("pg") - F.log("pb")) * UNIT).cast("long").alias("units"))


def scored(texts: DataFrame, counted: DataFrame) -> DataFrame:
    """(key, score) of every distinct ``t``: the mean over its characters."""
    rows = cut(texts)
    table = written(ratios(rows.filter("window is not null").select("window").distinct(), counted), "url-windows")
    if table.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(table), "window", "left")
    else:
        rows = spread_join(rows, table, ["window"], ["key"], "left")
    return rows.groupBy("key", "n").agg(F.sum("units").alias("units")).select("key", (F.coalesce("units", F.lit(0)) / UNIT / F.greatest("n", F.lit(1))).alias("score"))


def spare(t: Column) -> Column:
    """A fifth of the texts, by their digest: these set the threshold."""
    return F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % 5 == 0


def judged(pages: DataFrame, rules=RULES, *, url: str = "url") -> DataFrame:
    """The pages with host, path, rule, score, threshold (both null where a rule decides) and verdict."""
    out = ruled(pages, rules, url).withColumn("t", _text(F.col(url).cast("string")))
    known = out.filter("ruling is not null").select("t", (F.col("ruling") == "allow").alias("allowed"))
    open_ = out.filter("ruling is null")
    both = known.agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("b")).first()
    if both.a and both.b:
        counted = written(grams(known.filter(~spare(F.col("t"))), F.col("allowed")), "url-grams")
    if both.a and both.b and not counted.isEmpty():
        threshold = scored(known.filter(spare(F.col("t")) & F.col("allowed")), counted).agg(F.percentile_approx("score", LOST, 10_000).alias("s")).first().s
        scores = written(scored(open_, counted), "url-scores")
        differ = [f.name for f in pages.schema if "map<" not in f.dataType.simpleString()]
        open_ = spread_join(open_.withColumn("key", key(F.col("t"))), scores, ["key"], differ).drop("key")
    else:
        threshold, open_ = 0.0, open_.withColumn("score", F.lit(0.0))
    open_ = open_.withColumn("threshold", F.lit(float(threshold or 0.0)))
    out = open_.unionByName(out.filter("ruling is not null").withColumns({c: F.lit(None).cast("double") for c in ("score", "threshold")}))
    return out.withColumn("verdict", F.coalesce("ruling", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block"))).drop("ruling", "t")


def report(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
