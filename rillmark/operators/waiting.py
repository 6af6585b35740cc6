"""Waiting: commits that share a flush, fetches that wait for a message, leases whose time runs out in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.operators.folds import ordered_fold

MOST_WAIT_MS = 300_000


def shared_commits(requests: DataFrame, interval_ms: int) -> DataFrame:
    """(stream, part, started_ms, flushed_ms, waiters): the flushes that answer requests for durability.

    requests: stream, part, at_ms. The first one starts a flush that ends ``interval_ms`` later; those up to its end
    share it, and the next one starts another. Requests are counted per millisecond before they are shuffled.
    """

    def step(s: dict, row: dict) -> dict:
        if row["at_ms"] > s.get("end", row["at_ms"] - 1):
            s["end"] = row["at_ms"] + interval_ms
        return {"stream": row["stream"], "part": row["part"], "flushed_ms": s["end"], "n": row["n"]}

    counted = requests.filter("at_ms is not null").groupBy("stream", "part", "at_ms").agg(F.count("*").alias("n"))
    flushes = ordered_fold(counted, ["stream", "part"], ["at_ms"], step, "stream string, part int, flushed_ms long, n long")
    return flushes.groupBy("stream", "part", "flushed_ms").agg(F.sum("n").alias("waiters")).select("stream", "part", (F.col("flushed_ms") - interval_ms).alias("started_ms"), "flushed_ms", "waiters")


def woken(fetches: DataFrame, messages: DataFrame) -> DataFrame:
    """Fetches with ``woken_ms``: the time of the first message of their topic after ``at_ms`` and within ``wait_ms``, else null.

    fetches: topic, at_ms, wait_ms and others; messages: topic, ts_ms. Time is cut into pieces as long as the longest wait, so that a
    fetch finds its message in its own piece or the next; messages go to both, once per millisecond, and a hot topic is
    dealt over many tasks.
    """
    piece = lambda c: F.floor(c / MOST_WAIT_MS)
    times = messages.select("topic", "ts_ms").distinct().withColumn("_piece", F.explode(F.array(piece(F.col("ts_ms")), piece(F.col("ts_ms")) - 1)))
    both = fetches.withColumns({"_piece": piece(F.col("at_ms")), "_at": F.col("at_ms"), "_ts": F.lit(None).cast("long")}).unionByName(
        times.select("topic", "_piece", F.col("ts_ms").alias("_at"), F.col("ts_ms").alias("_ts")), allowMissingColumns=True
    )
    later = Window.partitionBy("topic", "_piece").orderBy(F.col("_at").desc(), F.col("_ts").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    first = both.withColumn("_first", F.last("_ts", ignorenulls=True).over(later)).filter("_ts is null")
    return first.withColumn("woken_ms", F.when(F.col("_first") <= F.col("at_ms") + F.col("wait_ms"), F.col("_first"))).drop("_piece", "_at", "_ts", "_first")


def admitted(fetches: DataFrame, per_consumer: int = 64) -> DataFrame:
    """(consumer, id, outcome, ended_ms) of fetches with ``woken_ms``: woken, timed_out, at_once, or refused.

    A connection, which fetches for one consumer, may wait once at a time and a consumer ``per_consumer`` times; one that is refused
    waits for nothing and takes no place. A fetch without a wait is never refused. A wait over the longest is an error.
    State is one consumer's waits, at most ``per_consumer``.
    """

    def step(active: dict, row: dict) -> dict:
        out = {"consumer": row["consumer"], "id": row["id"], "outcome": "at_once", "ended_ms": row["at_ms"]}
        for c in [c for c, end in active.items() if end <= row["at_ms"]]:
            del active[c]
        if row["wait_ms"] > MOST_WAIT_MS:
            out["outcome"] = "wait_too_long"
        elif row["wait_ms"] > 0:
            if row["connection"] in active:
                out["outcome"] = "connection_waits"
            elif len(active) >= per_consumer:
                out["outcome"] = "consumer_full"
            else:
                end = row["at_ms"] + row["wait_ms"] if row["woken_ms"] is None else row["woken_ms"]
                active[row["connection"]] = end
                out.update(outcome="timed_out" if row["woken_ms"] is None else "woken", ended_ms=end)
        return out

    rows = fetches.select("consumer", "connection", "id", "at_ms", "wait_ms", "woken_ms")
    return ordered_fold(rows, ["consumer"], ["at_ms", "id"], step, "consumer long, id long, outcome string, ended_ms long")


def run_out(leases: DataFrame, acks: DataFrame, timeout: str, late: str) -> DataFrame:
    """(id, at): leases of a stream that no acknowledgement reached within ``timeout``; each comes out when its time has passed.

    leases: id, at; acks: id, at. The timer is the watermark of a stream-stream outer join: a lease stays in the state store until both
    streams are ``late`` beyond its deadline, and is then let go whether acknowledged or not.
    """
    a = acks.withWatermark("at", late).select(F.col("id").alias("_id"), F.col("at").alias("_acked"))
    found = leases.withWatermark("at", late).join(a, F.expr(f"id = _id AND _acked >= at AND _acked <= at + INTERVAL {timeout}"), "left_outer")
    return found.filter("_id is null").select("id", "at")
