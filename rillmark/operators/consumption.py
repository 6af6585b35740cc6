"""Cursors, acknowledgements, fetches, retries, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY = ("stream", "part")


def start_offsets(log: DataFrame, at_ms: int, offset: int) -> DataFrame:
    """Where each kind of start position lies, per partition; the subject filter doesn't matter."""
    end = F.max("off") + 1
    return log.groupBy(*_KEY).agg(F.lit(0).cast("long").alias("earliest"), end.alias("latest"), F.lit(0).cast("long").alias("committed"), F.lit(offset).cast("long").alias("at_offset"), F.coalesce(F.min(F.when(F.col("ts_ms") >= at_ms, F.col("off"))), end).alias("at_time"))


def committed(log: DataFrame, matching: Column, acked: Column, start: int = 0) -> DataFrame:
    """One past the last offset of the unbroken run of acknowledged matching rows; the start where there is none. One shuffle."""
    rows = log.filter(matching & (F.col("off") >= start)).withColumn("_a", acked)
    gap = F.min(F.when(~F.col("_a"), F.col("off"))).over(Window.partitionBy(*_KEY))
    run = F.when(F.col("_gap").isNull() | (F.col("off") < F.col("_gap")), F.col("off"))
    return rows.withColumn("_gap", gap).groupBy(*_KEY).agg(F.coalesce(F.max(run) + 1, F.lit(start).cast("long")).alias("committed"))


def fetched(candidates: DataFrame, max_messages: int, max_bytes: int, size: str = "bytes") -> DataFrame:
    """Per consumer in (stream, part, off) order, up to the first row that breaks a limit; nothing after it.

    The count's limit comes first, so each task keeps ``max_messages`` rows of a consumer before the shuffle.
    """
    w = Window.partitionBy("consumer").orderBy(*_KEY, "off")
    first = candidates.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_messages)
    return first.withColumn("_b", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_b") <= max_bytes).drop("_n", "_b")


def gap_applied(cursors: DataFrame, floors: DataFrame) -> DataFrame:
    """Cursors below their partition's floor move to it and count a gap."""
    low = F.col("committed") < F.col("floor")
    return cursors.join(floors, [*_KEY]).select("consumer", *_KEY, F.greatest("committed", "floor").alias("committed"), F.when(low, 1).otherwise(0).cast("long").alias("gaps"))


def floors_applied(cursors: DataFrame, floors: DataFrame) -> DataFrame:
    """(stream, part, committed, gaps, acked): cursors (committed, acked offsets) after retention, with how many acknowledgements are left."""
    moved = cursors.join(floors, [*_KEY]).withColumn("_to", F.greatest("committed", "floor"))
    return moved.select(*_KEY, F.col("_to").alias("committed"), F.when(F.col("committed") < F.col("floor"), 1).otherwise(0).cast("long").alias("gaps"), F.size(F.filter("acked", lambda x: x >= F.col("_to"))).cast("long").alias("acked"))


def assigned(partitions: int, members: DataFrame, how: str) -> DataFrame:
    """(grp, part, member) by range or round robin over the members in name order."""
    ranked = members.groupBy("grp").agg(F.array_sort(F.collect_set("member")).alias("m"))
    p = ranked.select("grp", "m", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("part"))
    n = F.size("m")
    at = F.floor(F.col("part") * n / F.lit(partitions)).cast("int") if how == "range" else F.col("part") % n
    return p.select("grp", "part", F.get("m", at).alias("member"))


def fenced_commits(commits: DataFrame, owners: DataFrame, generation: int) -> DataFrame:
    """commits (seq, part, generation, member, offset) with ``outcome``: a commit counts in the present generation, from the
    partition's owner, and above what was committed before; nothing is committed at first, so 0 never counts."""
    rows = commits.join(owners, "part", "left").withColumn("_mine", F.coalesce((F.col("generation") == generation) & (F.col("member") == F.col("owner")), F.lit(False)))
    before = F.max(F.when(F.col("_mine"), F.col("offset"))).over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.coalesce(before, F.lit(0)))
    outcome = F.when(F.col("generation") != generation, "stale generation").when(~F.col("_mine"), "not the owner").when(F.col("offset") > F.col("_before"), "committed").otherwise("unchanged")
    return rows.withColumn("outcome", outcome).drop("_mine", "_before", "owner")


def expanded(requests: DataFrame, most: int, start: int = 1) -> DataFrame:
    """(grp, seq, outcome, partitions) of requests for partition counts, which only grow, up to ``most``."""
    w = Window.partitionBy("grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.when(F.col("asked") <= most, F.col("asked"))).over(w), F.lit(start))
    rows = requests.withColumn("_before", before)
    outcome = F.when(F.col("asked") < F.col("_before"), "decrease").when(F.col("asked") > most, "quota").when(F.col("asked") == F.col("_before"), "unchanged").otherwise("expanded")
    return rows.select("grp", "seq", outcome.alias("outcome"), F.when(F.col("asked").between(F.col("_before"), F.lit(most)), F.col("asked")).otherwise(F.col("_before")).alias("partitions"))


def registrations(rows: DataFrame, version: int, first_revision: int, revision: int) -> DataFrame:
    """(seq, broker, outcome, session, fenced, snapshot, updates) of brokers' registrations (version, broker, incarnation, last_revision).

    An incarnation below the broker's last is stale; an accepted one ends the session before. Updates ``first_revision`` to
    ``revision`` are kept: who lacks an earlier one gets a snapshot (one row) instead. Sessions number what is accepted.
    """
    bad = F.when(F.col("version") != version, "unsupported").when((F.col("broker") == 0) | (F.col("incarnation") == 0), "invalid")
    w = Window.partitionBy("broker").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_bad", bad).withColumn("_before", F.max(F.when(F.col("_bad").isNull(), F.col("incarnation"))).over(w))
    rows = rows.withColumn("outcome", F.coalesce("_bad", F.when(F.col("incarnation") < F.col("_before"), "stale").otherwise("accepted")))
    ok = F.col("outcome") == "accepted"
    # sessions in two levels: ranges of seq, and within one
    rows = rows.withColumn("_b", F.floor(F.col("seq") / (1 << 20)))
    per = rows.groupBy("_b").agg(F.count_if(ok).alias("_n"))
    before = per.select("_b", (F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    within = F.count_if(ok).over(Window.partitionBy("_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    snapshot = F.col("last_revision") + 1 < first_revision
    updates = F.when(snapshot, 1).otherwise(F.greatest(revision - F.col("last_revision"), F.lit(0)))
    return rows.withColumn("_w", within).join(before, "_b").select("seq", "broker", "outcome", F.when(ok, F.col("_base") + F.col("_w")).alias("session"), (ok & F.col("_before").isNotNull()).alias("fenced"), F.when(ok, snapshot).alias("snapshot"), F.when(ok, updates).alias("updates"))


def lag(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """high watermark - committed, not below 0."""
    ends = log.groupBy(*_KEY).agg((F.max("off") + 1).alias("high"))
    return ends.join(cursors, [*_KEY], "left").select(*_KEY, "high", F.greatest(F.col("high") - F.coalesce("committed", F.lit(0)), F.lit(0)).cast("long").alias("lag"))
