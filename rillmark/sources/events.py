"""The driver's ``events`` table as a log: stream by pattern binding, partition by key hash, offset by order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmark.functions import hashing, subjects

PARTITIONS = 8
BINDINGS = (("purchases", "events/purchase/**"), ("telemetry", "events/click/**"), ("telemetry", "events/error/**"), ("telemetry", "events/signup/**"), ("telemetry", "events/view/**"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(messages: DataFrame, bindings=BINDINGS) -> DataFrame:
    """Adds ``stream``: the one that owns the subject, or null. Patterns are literals, so this is a projection, no join."""
    stream = F.lit(None).cast("string")
    for name, pattern in sorted(bindings, reverse=True):
        stream = F.when(subjects.matches(F.col("subject"), pattern), F.lit(name)).otherwise(stream)
    return messages.withColumn("stream", stream)


def messages(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("events/"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("subject"),
        F.when(F.col("event_type") != "view", F.col("user_id").cast("string")).alias("key"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("props").alias("payload"), (F.col("event_id") + 1).alias("seq"), "user_id", "event_type", "value")


def partitioned(log: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """Adds ``part``: a key decides if there is one, else the subject."""
    return log.withColumn("part", hashing.partition_of(F.coalesce("key", "subject"), partitions))


def appended(log: DataFrame, base: int = 0) -> DataFrame:
    """Adds ``off``: the running number per stream and partition in the order of ``seq``."""
    return log.withColumn("off", (F.row_number().over(Window.partitionBy("stream", "part").orderBy("seq")) - 1 + base).cast("long"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appended(partitioned(bound(messages(table(spark, sf_dir, "events")))))
