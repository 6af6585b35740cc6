"""Pattern joins: who receives a subject. A set of patterns is split so that most of it is equi-joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions import hashing, subjects

#: Patterns up to this many are broadcast; above, the equi-joins shuffle.
BROADCAST_PATTERNS = 50_000


def fan_out(messages: DataFrame, patterns: list[tuple[str, str]], subject: str = "subject") -> DataFrame:
    """messages with ``subscriber`` for each (subscriber, pattern) that matches.

    Patterns of one shape (the places of their literals, the number of segments, tail or none) become one
    equi-join on the literal segments, so the work grows with messages times shapes, not times patterns.
    """
    spark, shapes, rows = messages.sparkSession, {}, []
    for owner, p in patterns:
        parts = p.split("/")
        tail = parts[-1] == "**"
        parts = parts[:-1] if tail else parts
        where = tuple(i for i, x in enumerate(parts) if x != "*")
        shape = shapes.setdefault((len(parts), tail, where), len(shapes))
        rows.append((owner, shape, "/".join(parts[i] for i in where)))
    if not rows:
        return messages.limit(0).withColumn("subscriber", F.lit(""))
    parts, keys = F.split(subject, "/"), []
    for (n, tail, where), shape in shapes.items():
        fits = F.size(parts) >= n if tail else F.size(parts) == n
        key = F.concat_ws("/", *[F.get(parts, F.lit(i)) for i in where]) if where else F.lit("")
        keys.append(F.when(fits, F.struct(F.lit(shape).alias("_shape"), key.alias("_key"))))
    side = spark.createDataFrame(rows, "subscriber string, _shape int, _key string").distinct()
    side = F.broadcast(side) if len(rows) <= BROADCAST_PATTERNS else side
    # one reading of the messages: a row per shape that fits, then one join
    rows = messages.withColumn("_k", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull()))).withColumns({"_shape": F.col("_k._shape"), "_key": F.col("_k._key")})
    return rows.join(side, ["_shape", "_key"]).drop("_shape", "_key", "_k")


def interested(messages: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """The subscribers that any message matches."""
    return fan_out(messages, patterns).select("subscriber").distinct()


def binding_conflicts(spark, bindings: list[tuple[str, str]]) -> DataFrame:
    """Pairs of patterns of different streams that may match one subject."""
    rows = [(a, p, b, q) for i, (a, p) in enumerate(bindings) for b, q in bindings[i + 1 :] if a != b and subjects.overlap(p, q)]
    return spark.createDataFrame(rows, "stream_a string, pattern_a string, stream_b string, pattern_b string")


def catalog_errors(spark, bindings: list[tuple[str, str]]) -> DataFrame:
    """(stream, error) of a catalog's streams in the order they are given: an invalid pattern, a name twice, an overlap with a later stream."""
    rows, seen = [], set()
    valid = [(n, p) for n, p in bindings if re.search(subjects.PATTERN, p)]
    for n, p in bindings:
        if (n, p) not in valid:
            rows.append((n, "invalid"))
        elif n in seen:
            rows.append((n, "duplicate"))
        seen.add(n)
    rows += [(a, f"overlap {b}") for i, (a, p) in enumerate(valid) for b, q in valid[i + 1 :] if a != b and subjects.overlap(p, q)]
    return spark.createDataFrame(sorted(set(rows)), "stream string, error string")


def request_reply(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Each request with the reply sent to its address."""
    return requests.join(replies, requests.reply_to == replies.subject, "left")


def rendezvous(partitions: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The k nodes with the highest hash of (stream, partition, node) for each partition, ties by node."""
    from pyspark.sql import Window

    pairs = partitions.join(F.broadcast(nodes))  # nodes of one cluster: a small table by nature
    h = hashing.fnv1a(F.concat_ws("/", "stream", F.col("part").cast("string"), F.col("node").cast("string")))
    ranked = pairs.withColumn("h", h).withColumn("rank", F.row_number().over(Window.partitionBy("stream", "part").orderBy(F.desc("h.hi"), F.desc("h.lo"), "node")))
    return ranked.filter(F.col("rank") <= k).drop("h")
