"""Retention, compaction, views: windows over (stream, partition) in offset order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _partition():
    return Window.partitionBy("stream", "part")


def age_floor(log: DataFrame, now_ms: Column | int, max_age_ms: int) -> DataFrame:
    """Rows with ``floor``: the first offset that isn't old, or one past the end. Only a prefix goes."""
    young = F.when(F.lit(now_ms) - F.col("ts_ms") <= max_age_ms, F.col("off"))
    return log.withColumn("floor", F.coalesce(F.min(young).over(_partition()), F.max("off").over(_partition()) + 1))


def retained_by_age(log: DataFrame, now_ms, max_age_ms: int) -> DataFrame:
    return age_floor(log, now_ms, max_age_ms).filter("off >= floor").drop("floor")


def retained_by_bytes(log: DataFrame, max_bytes: int, size: str = "bytes") -> DataFrame:
    """The longest suffix of at most ``max_bytes``; it may be empty."""
    return log.withColumn("_sum", F.sum(size).over(_partition().orderBy(F.desc("off")).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_sum") <= max_bytes).drop("_sum")


def retention_status(log: DataFrame, now_ms: int, max_age_ms: int, max_bytes: int, size: str = "bytes") -> DataFrame:
    """Per partition after age, then bytes: earliest, next offset, retained and deleted messages and bytes. One pass."""
    suffix = F.sum(size).over(_partition().orderBy(F.desc("off")).rowsBetween(Window.unboundedPreceding, 0))
    kept = (F.col("off") >= F.col("floor")) & (F.col("_sum") <= max_bytes)
    rows = age_floor(log.withColumn("_sum", suffix), now_ms, max_age_ms).withColumn("_k", kept)
    of = lambda c: F.coalesce(F.sum(F.when(F.col("_k"), c)), F.lit(0))
    per = rows.groupBy("stream", "part").agg((F.max("off") + 1).alias("next_offset"), F.min(F.when(F.col("_k"), F.col("off"))).alias("first"), F.count("*").alias("n"), F.sum(size).alias("b"), of(F.lit(1)).alias("retained_messages"), of(F.col(size)).alias("retained_bytes"))
    return per.select("stream", "part", F.coalesce("first", "next_offset").alias("earliest"), "next_offset", "retained_messages", "retained_bytes", (F.col("n") - F.col("retained_messages")).alias("deleted_messages"), (F.col("b") - F.col("retained_bytes")).alias("deleted_bytes"))


def compacted(log: DataFrame) -> DataFrame:
    """The last row of each key in its partition, and every row without a key (each is a group of its own in the one window)."""
    last = Window.partitionBy("stream", "part", "key", F.when(F.col("key").isNull(), F.col("off"))).orderBy(F.desc("off"), F.desc("seq"))
    return log.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def superseded(log: DataFrame) -> DataFrame:
    """The rows that a later one of their key replaces; each append replaces one at most."""
    later = F.lead("off").over(Window.partitionBy("stream", "part", "key").orderBy("off", "seq"))
    return log.filter("key is not null").withColumn("_later", later).filter("_later is not null").drop("_later")


def applied(updates: DataFrame, arrival: str) -> DataFrame:
    """The updates that a view takes as they arrive: none whose offset is behind its partition's; an equal one is taken again."""
    top = F.max("off").over(_partition().orderBy(arrival, "off").rowsBetween(Window.unboundedPreceding, -1))
    return updates.withColumn("_top", top).filter("_top is null or off >= _top").drop("_top")


def restored(updates: DataFrame, every: int) -> DataFrame:
    """(key, value, off): the state at the last checkpoint, one each ``every`` offsets, with the deltas after it; a null value deletes."""
    at = updates.agg((F.floor(F.max("off") / every) * every).alias("_at"))
    rows = updates.crossJoin(F.broadcast(at))  # one row
    last = lambda df: df.groupBy("key").agg(F.max_by(F.struct("value", "off"), "off").alias("u"))
    snapshot, deltas = last(rows.filter("off <= _at")), last(rows.filter("off > _at"))
    both = snapshot.withColumnRenamed("u", "s").join(deltas, "key", "full").select("key", F.coalesce("u", "s").alias("u"))
    return both.select("key", "u.value", "u.off").filter("value is not null")


def view(updates: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """The view's rows by rebuild: the last update of each key in (stream, part, off) order; a null value deletes."""
    last = updates.groupBy(key).agg(F.max_by(F.struct(value, "stream", "part", "off"), F.struct("stream", "part", "off")).alias("u"))
    return last.select(key, f"u.{value}", "u.stream", "u.part", "u.off").filter(F.col(value).isNotNull())


def view_changes(updates: DataFrame, since: int, window: int) -> DataFrame:
    """The changes after ``since`` of the last ``window`` ones; fewer than asked for means the cursor has expired."""
    top = F.broadcast(updates.agg(F.max("sequence").alias("_top")))  # one row
    return updates.crossJoin(top).filter((F.col("sequence") > since) & (F.col("sequence") > F.col("_top") - window)).drop("_top")


def watched(watchers: DataFrame, window: DataFrame) -> DataFrame:
    """watchers (since) with ``expired`` (the change after ``since`` is gone) and else ``changes``; window: one row of first and last."""
    rows = watchers.crossJoin(F.broadcast(window)).withColumn("expired", F.col("since") + 1 < F.col("first"))
    return rows.withColumn("changes", F.when(~F.col("expired"), F.greatest(F.col("last") - F.col("since"), F.lit(0)))).drop("first", "last")


def offset_gaps(log: DataFrame) -> DataFrame:
    """Rows whose offset doesn't follow the one before."""
    return log.withColumn("before", F.lag("off").over(_partition().orderBy("off"))).filter(F.col("off") != F.col("before") + 1)
