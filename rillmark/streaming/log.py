"""The log as a stream: unbounded reads, windows with a watermark, appends that happen once.

A batch's result goes to a folder of its number, written whole, so a batch that runs again after a failure
replaces itself; a reader takes each key's last batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rillmark.sources.shared import fresh


def read(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A table's files as a stream; the pattern takes a single file and a folder alike. Times get the zone that event time needs."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def windowed(events: DataFrame, length: str, *by: str, late: str | None = "1 hour") -> DataFrame:
    """Counts per tumbling window and key; the watermark lets go of windows ``late`` behind. None keeps all windows (update mode), so nothing is late."""
    return (events if late is None else events.withWatermark("ts", late)).groupBy(F.window("ts", length), *by).agg(F.count("*").alias("n")).select(F.unix_millis("window.start").alias("start_ms"), *by, "n")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first message of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there; the batches' rows with ``batch``."""
    spark, path = stream.sparkSession, fresh(stream.sparkSession, what)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows/batch=-1")  # a stream without files has a result too

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*stream.schema, StructField("batch", IntegerType())])).parquet(f"{path}/rows")


def latest(rows: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """An update stream's last value per key."""
    return rows.groupBy(*keys).agg(*[F.max_by(v, "batch").alias(v) for v in values])


def view(events: DataFrame, key: str, value: Column, order: str) -> DataFrame:
    """The last value per key, kept incrementally (for update mode)."""
    return events.groupBy(key).agg(F.max(F.struct(F.col(order).alias("position"), value.alias("value"))).alias("v")).select(key, "v.position", "v.value")
