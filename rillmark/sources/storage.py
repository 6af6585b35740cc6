"""The log as files: a folder per stream and partition, ordered within, so a reader opens only what it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import subjects
from rillmark.sources import shared


def written_log(log: DataFrame, what: str) -> str:
    """Writes rows with stream, part and off; returns where."""
    path = shared.fresh(log.sparkSession, what)
    log.repartition("stream", "part").sortWithinPartitions("stream", "part", "off").write.partitionBy("stream", "part").parquet(path)
    return path


def replayed(spark: SparkSession, path: str, assigned: list[tuple[str, int]] | None = None) -> DataFrame:
    """The rows of a log, or of assigned (stream, part) only: a filter on folders, so others aren't opened.

    A file that was cut short is left out with what it held (``ignoreCorruptFiles``); rows before it stay.
    """
    rows = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    if assigned is not None:
        wanted = F.lit(False)
        for stream, part in assigned:
            wanted = wanted | ((F.col("stream") == stream) & (F.col("part") == part))
        rows = rows.filter(wanted)
    return rows


def matching_offsets(spark: SparkSession, path: str, stream: str, part: int, pattern: str) -> DataFrame:
    """The offsets of a partition whose subjects match; the pattern's literal beginning reaches the scan."""
    return replayed(spark, path, [(stream, part)]).filter(subjects.matches(F.col("subject"), pattern)).select("off")
