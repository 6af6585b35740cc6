"""Sinks that a repeated write doesn't change, exports, and backups as tables of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

POSITION = ["stream", "part", "off"]


def _held(spark: SparkSession, path: str, schema) -> DataFrame:
    """A sink's rows; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def checksum(columns: list[str]) -> Column:
    """A row's content as one number; null and empty differ."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), c) for c in columns])


def append_once(rows: DataFrame, path: str, batch: str) -> None:
    """Appends rows that the sink lacks, in a folder of the batch's own, which a repeated batch overwrites.

    Rows: stream, part, off and content. A position that the sink has from another batch with the same content is
    no news; with other content nothing is written and ValueError is raised. The sink is laid out by stream and
    part, so a batch reads only its partitions' positions. Two rows of one position in a batch must agree.
    """
    content = sorted(set(rows.columns) - set(POSITION))
    new = rows.withColumn("checksum", checksum(content))
    held = _held(rows.sparkSession, path, new.withColumn("batch", F.lit("")).schema).filter(F.col("batch") != batch).select(*POSITION, F.col("checksum").alias("_h"))
    both = new.groupBy(*POSITION).agg(F.min("checksum").alias("_a"), F.max("checksum").alias("_b")).join(held, POSITION, "left")
    if not both.filter((F.col("_a") != F.col("_b")) | (F.col("_h") != F.col("_a"))).isEmpty():
        raise ValueError("a position has other content")
    fresh = new.join(held, POSITION, "left_anti").dropDuplicates(POSITION)
    fresh.write.mode("overwrite").partitionBy("stream", "part").parquet(f"{path.rstrip('/')}/batch={batch}")


def checkpoints(rows: DataFrame) -> DataFrame:
    """How far a batch brings each partition."""
    return rows.groupBy("stream", "part").agg(F.max("off").alias("off"))


def committed(commits: DataFrame) -> DataFrame:
    """(stream, part, generation, off): a partition's checkpoint after commits; those of generations before the highest don't count."""
    return commits.groupBy("stream", "part").agg(F.max(F.struct("generation", "off")).alias("c")).select("stream", "part", "c.*")


def sunk(stream: DataFrame, path: str, state: str) -> None:
    """Runs a stream over all that is there into `append_once`; the checkpoint in ``state`` moves after the write."""

    def write(rows: DataFrame, batch: int) -> None:
        append_once(rows, path, str(batch))

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def exported(rows: DataFrame, path: str, kind: str) -> DataFrame:
    """Rows written as JSON lines or CSV and read again with the same columns."""
    options = {"header": True, "escape": '"', "nullValue": "\\N"} if kind == "csv" else {"ignoreNullFields": False}
    rows.write.format(kind).options(**options).save(path)
    return rows.sparkSession.read.format(kind).schema(rows.schema).options(**options).load(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", path.rstrip("/").rpartition("/")[2] + "/", -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def incremental(now: DataFrame, parent: DataFrame) -> DataFrame:
    """The manifest's files that the parent backup lacks in this form."""
    return now.join(parent.select("path", "sha256"), ["path", "sha256"], "left_anti")


def broken_links(backups: DataFrame) -> DataFrame:
    """Backups of a chain (chain, position, backup_id, parent_id) that don't follow the one before; the first has no parent."""
    before = F.lag("backup_id").over(Window.partitionBy("chain").orderBy("position"))
    return backups.withColumn("_b", before).filter(~F.col("parent_id").eqNullSafe(F.col("_b"))).drop("_b")


def restored(objects: DataFrame) -> DataFrame:
    """(path, sha256) after a chain: the object of the highest position wins."""
    return objects.groupBy("path").agg(F.max_by("sha256", "position").alias("sha256"))
