"""The state that a write-ahead log's records leave, by joins and last-record-wins instead of a record at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUBLISH, CONSUMER, ATTEMPT, ACK, APPEND, CURSOR, CONSUMER_DELETE, DEAD, DEAD_PURGE, PRODUCER, GROUP, CURSOR_DELTA = range(1, 13)


def consumers(records: DataFrame) -> DataFrame:
    """(consumer, start, cursor) of those that exist: the first definition after the last deletion, and the first cursor after that."""
    of = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("ord")))
    gone = records.groupBy("consumer").agg(F.coalesce(of(CONSUMER_DELETE, F.max), F.lit(-1)).alias("gone"))
    later = records.filter(F.col("kind").isin(CONSUMER, CURSOR, CURSOR_DELTA)).join(gone, "consumer").filter("ord > gone")
    start = later.groupBy("consumer").agg(of(CONSUMER, F.min).alias("start")).filter("start is not null")
    cursor = later.filter(F.col("kind") != CONSUMER).join(start, "consumer").filter("ord > start").groupBy("consumer").agg(F.min("ord").alias("cursor"))
    return start.join(cursor, "consumer", "left")


def deliveries(records: DataFrame, matches: Column) -> DataFrame:
    """(consumer, msg, state) of each existing consumer's messages: pending, in_flight or acked.

    records: ord, kind, consumer, msg. ``matches`` tells from consumer and msg whether the filter fits. What is published
    before a consumer exists, or after it has a cursor, isn't pending for it; an acknowledged message never is again.
    """
    live = consumers(records)
    own = records.filter(F.col("kind").isin(ATTEMPT, ACK)).select("ord", "kind", "consumer", "msg").join(live, "consumer").filter("ord > start")
    told = own.groupBy("consumer", "msg").agg(F.max(F.when(F.col("kind") == ACK, "acked").otherwise(None)).alias("acked"), F.lit("in_flight").alias("told"))
    published = records.filter(F.col("kind").isin(PUBLISH, APPEND)).select(F.col("ord").alias("at"), "msg")
    # consumers are few beside messages; each message is wanted by the consumers whose filter fits, as in a fan-out
    wanted = published.join(F.broadcast(live), F.expr("at > start and (cursor is null or at < cursor)")).filter(matches).select("consumer", "msg").distinct()
    both = wanted.join(told, ["consumer", "msg"], "full")
    return both.select("consumer", "msg", F.coalesce("acked", "told", F.lit("pending")).alias("state"))


def last_of(records: DataFrame, put: list[int], drop: list[int], key: str) -> DataFrame:
    """(key, ord) of the keys whose last record puts rather than drops."""
    last = records.filter(F.col("kind").isin(*put, *drop)).groupBy(key).agg(F.max_by(F.struct("kind", "ord"), "ord").alias("r"))
    return last.filter(F.col("r.kind").isin(*put)).select(key, F.col("r.ord").alias("ord"))


def summary(records: DataFrame, matches: Column) -> DataFrame:
    """(entity, n, last): how many of each the log leaves, and the order of the last record that made one."""
    count = lambda df, name, at: df.agg(F.lit(name).alias("entity"), F.count("*").alias("n"), F.max(at).alias("last"))
    of = lambda *kinds: records.filter(F.col("kind").isin(*kinds))
    states = deliveries(records, matches).groupBy(F.col("state").alias("entity")).agg(F.count("*").alias("n"), F.max("msg").alias("last"))
    parts = [count(of(PUBLISH, APPEND).select("msg", "ord").groupBy("msg").agg(F.max("ord").alias("ord")), "messages", "ord"), count(consumers(records), "consumers", "start"), count(last_of(records, [DEAD], [DEAD_PURGE], "msg"), "dead_letters", "ord"), count(of(PRODUCER).groupBy("consumer", "msg").agg(F.max("ord").alias("ord")), "producer_sequences", "ord"), count(of(GROUP).groupBy("consumer").agg(F.max("ord").alias("ord")), "groups", "ord")]
    for p in parts:
        states = states.unionByName(p)
    return states
