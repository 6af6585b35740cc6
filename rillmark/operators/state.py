"""Folds: idempotent producers, transactions, governance, replication, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, window: int = 4096) -> DataFrame:
    """The first of each (producer, epoch, sequence) of a producer's highest epoch, within its last ``window`` sequences."""
    top = events.groupBy("producer").agg(F.max("epoch").alias("epoch"))
    live = events.join(top, ["producer", "epoch"], "left_semi")
    first = Window.partitionBy("producer", "epoch", "sequence").orderBy("seq")
    one = live.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    last = Window.partitionBy("producer").orderBy(F.desc("sequence"))
    return one.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= window).drop("_r")


def sequence_gaps(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("producer", "epoch").orderBy("sequence")
    return events.withColumn("before", F.lag("sequence").over(w)).filter((F.col("sequence") != F.col("before") + 1) | (F.col("before").isNull() & (F.col("sequence") > 1)))


def transaction_states(events: DataFrame, now_ms: int) -> DataFrame:
    """The last state of each transaction; an open one past its deadline is aborted."""
    last = events.groupBy("txn").agg(F.max_by("kind", "seq").alias("kind"), F.max("deadline_ms").alias("deadline_ms"))
    return last.select("txn", F.when(F.col("kind").isin("commit", "abort"), F.col("kind")).when(F.col("deadline_ms") <= now_ms, "abort").otherwise(F.col("kind")).alias("state"))


def visible(writes: DataFrame, states: DataFrame) -> DataFrame:
    """Only what committed transactions wrote."""
    return writes.join(states.filter("state = 'commit'"), "txn", "left_semi")


def authorized(requests: DataFrame, bindings: DataFrame, roles: DataFrame, now_ms: int) -> DataFrame:
    """Requests with ``allowed``: an unexpired binding in scope whose role has the permission."""
    live = bindings.filter(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms)).join(roles, "role").select("subject", "tenant", F.explode("permissions").alias("permission")).distinct()
    return requests.join(live.withColumn("allowed", F.lit(True)), ["subject", "tenant", "permission"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def audit_breaks(chain: DataFrame) -> DataFrame:
    """Records that don't carry their predecessor's hash. One writer's chain is one ordered sequence."""
    w = Window.partitionBy("chain").orderBy("sequence")
    return chain.withColumn("_p", F.lag("hash", 1, "").over(w)).filter(F.col("previous_hash") != F.col("_p")).drop("_p")


def high_watermarks(replicas: DataFrame) -> DataFrame:
    """The offset that a majority of each partition's replicas has reached."""
    got = F.sort_array(F.collect_list("match_offset"), asc=False)
    return replicas.groupBy("stream", "part").agg(got.alias("o"), F.count("*").alias("n")).select("stream", "part", F.get("o", F.floor(F.col("n") / 2).cast("int")).alias("high_watermark"))


def distribution(samples: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, least, mean, population deviation, greatest, and percentiles at index ceil((n - 1) * p), exactly.

    No task sorts a whole group: approximate quantiles, good to a thousandth, bound each percentile from both sides by five
    thousandths. A second pass counts what is below, and the values of the hundredth in between one by one; only these are sorted.
    """
    wanted, near = (0.5, 0.95, 0.99), 0.005
    bounds = F.percentile_approx(value, [min(1.0, p + d) for p in wanted for d in (-near, near)], 1000)
    facts = samples.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("deviation"), F.max(value).alias("greatest"), bounds.alias("_q"))
    low, high = (lambda i: F.get("_q", F.lit(2 * i))), (lambda i: F.get("_q", F.lit(2 * i + 1)))
    inside = lambda i, v: F.col(v).between(low(i), high(i))
    near_one = reduce(Column.__or__, (inside(i, value) for i in range(len(wanted))))
    placed = samples.select(*by, value).join(facts.select(*by, "_q"), by)
    counted = placed.groupBy(*by, F.when(near_one, F.col(value)).alias("_v")).agg(F.count("*").alias("_c"), *[F.count_if(F.col(value) < low(i)).alias(f"_b{i}") for i in range(len(wanted))])
    below = counted.groupBy(*by).agg(*[F.sum(f"_b{i}").alias(f"_b{i}") for i in range(len(wanted))])
    few = counted.filter("_v is not null").select(*by, "_v", "_c").join(facts.select(*by, "n", "_q"), by)
    nth = F.array(*[F.when(inside(i, "_v"), F.lit(i)) for i in range(len(wanted))])
    upto = F.sum("_c").over(Window.partitionBy(*by, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = few.withColumn("_p", F.explode(F.filter(nth, lambda i: i.isNotNull()))).withColumn("_upto", upto).join(below, by)
    index = lambda p: F.ceil((F.col("n") - 1) * F.lit(p))
    at = lambda i, p: (F.col("_p") == i) & (F.col("_upto") + F.col(f"_b{i}") > index(p)) & (F.col("_upto") - F.col("_c") + F.col(f"_b{i}") <= index(p))
    picks = ranked.groupBy(*by).agg(*[F.max(F.when(at(i, p), F.col("_v"))).alias(f"p{str(p)[2:]}") for i, p in enumerate(wanted)])
    return facts.drop("_q").join(picks, by)


def histogram(samples: DataFrame, value: Column, bounds: tuple = (9, 99, 999, 9999, 99999)) -> DataFrame:
    """Cumulative counts per upper bound, with the total as +Inf, in one pass."""
    row = samples.agg(*[F.count_if(value <= b).alias(str(b)) for b in bounds], F.count("*").alias("+Inf"))
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, row.columns)), F.array(*[F.col(f"`{c}`") for c in row.columns])))).toDF("le", "n")


def throughput(samples: DataFrame) -> DataFrame:
    """Operations, bytes and greatest time over all, by role, and by role and client."""
    return samples.rollup("role", "client").agg(F.count("*").alias("ops"), F.sum("bytes").alias("bytes"), F.max("elapsed").alias("elapsed"))
