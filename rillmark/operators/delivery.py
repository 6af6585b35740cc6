"""Leases of delivered messages: (consumer, seq, delivery_id, attempt, deadline_ms, retry_waiting)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expired(leases: DataFrame, now_ms: int, max_attempts: int, delay_ms: Column, limit: int | None = None) -> DataFrame:
    """Due leases with what becomes of them: ``outcome``, ``attempt_after``, ``deadline_after``.

    A delivery out of attempts is terminal; one with a retry delay waits; one without, or that has waited, is
    pending again. ``limit`` takes the earliest deadlines only.
    """
    due = leases.filter(F.col("deadline_ms") <= now_ms)
    if limit is not None:
        due = due.orderBy("deadline_ms", "consumer", "seq").limit(limit)
    fresh = ~F.col("retry_waiting")
    outcome = F.when(fresh & (F.col("attempt") >= max_attempts), "terminal").when(fresh & (delay_ms > 0), "retry_waiting").otherwise("pending")
    after = F.col("attempt") + F.when(fresh & (F.col("outcome") != "terminal"), 1).otherwise(0)
    return due.withColumn("outcome", outcome).withColumn("attempt_after", after).withColumn("deadline_after", F.when(F.col("outcome") == "retry_waiting", now_ms + delay_ms))


def next_pull(leases: DataFrame, pending: DataFrame, now_ms: int, max_in_flight: int) -> DataFrame:
    """(consumer, seq, attempt): the least expired lease, even at the limit; else the least pending message, below it."""
    late = F.col("deadline_ms") <= now_ms
    held = leases.groupBy("consumer").agg(F.min(F.when(late, F.struct("seq", "attempt"))).alias("late"), F.count("*").alias("in_flight"))
    new = pending.groupBy("consumer").agg(F.min("seq").alias("new"))
    room = F.coalesce("in_flight", F.lit(0)) < max_in_flight
    both = held.join(new, "consumer", "full")
    return both.select("consumer", F.coalesce("late.seq", F.when(room, F.col("new"))).alias("seq"), F.when(F.col("late").isNotNull(), F.col("late.attempt") + 1).otherwise(1).alias("attempt")).filter("seq is not null")


def granted(pulled: DataFrame, now_ms: int, timeout_ms: int, last_delivery: int) -> DataFrame:
    """Leases of what is pulled (consumer, seq, attempt; one row per consumer): a deadline, and delivery ids after the last one in consumer order."""
    nth = F.row_number().over(Window.orderBy("consumer"))  # as many rows as consumers
    return pulled.select("consumer", "seq", (F.lit(last_delivery).cast("long") + nth).alias("delivery_id"), "attempt", F.lit(now_ms + timeout_ms).cast("long").alias("deadline_ms"))


def before_undue(candidates: DataFrame, now_ms: int) -> DataFrame:
    """Candidates ahead of a consumer's first message that isn't due yet."""
    block = candidates.filter(F.col("scheduled_ms") > now_ms).groupBy("consumer").agg(F.min("seq").alias("_block"))
    return candidates.join(block, "consumer", "left").filter(F.col("_block").isNull() | (F.col("seq") < F.col("_block"))).drop("_block")


def valid_acks(acks: DataFrame, leases: DataFrame) -> DataFrame:
    """Acknowledgements of the active delivery only."""
    active = leases.groupBy("consumer", "seq").agg(F.max("delivery_id").alias("delivery_id"))
    return acks.join(active, ["consumer", "seq", "delivery_id"], "left_semi")


def extended(leases: DataFrame, now_ms: int, extension_ms: Column, most_ms: int) -> DataFrame:
    """Leases whose extension is allowed, with the later of deadline and now moved by it."""
    return leases.filter(extension_ms <= most_ms).withColumn("deadline_ms", F.greatest("deadline_ms", F.lit(now_ms)) + extension_ms)


def restarted(leases: DataFrame) -> DataFrame:
    """After a restart what was in flight is pending with one more attempt."""
    return leases.select("consumer", "seq", (F.col("attempt") + 1).alias("attempt"))


def dead_letters(dead: DataFrame, purged_before_ms: int) -> DataFrame:
    """What a purge of older ones leaves."""
    return dead.filter(F.col("deadline_ms") >= purged_before_ms)
