"""Queries that write through the sinks and read back what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.plans.queries import _LOG, _log
from rillmark.sources import events as ev
from rillmark.sources import sinks
from rillmark.sources.shared import fresh
from rillmark.streaming import log as stream


def _rows(s, d):
    return _log(s, d).select("stream", "part", "off", "subject", "payload")


def snk_append_once(s, d):
    """Two overlapping batches, the second one twice: each row once, with the batch that brought it."""
    path, rows = fresh(s, "sink"), _rows(s, d)
    for batch, some in (("0", "off % 3 <> 0"), ("1", "off % 2 = 0"), ("1", "off % 2 = 0")):
        sinks.append_once(rows.filter(some), path, batch)
    return s.read.parquet(path).select("stream", F.col("part").cast("int").alias("part"), "off", "subject", "payload", F.col("batch").cast("int").alias("batch"))


SNK_APPEND_ONCE = _LOG + " SELECT stream, part, off, subject, payload, CASE WHEN off % 3 <> 0 THEN 0 ELSE 1 END AS batch FROM log WHERE off % 3 <> 0 OR off % 2 = 0"


def snk_generations(s, d):
    """Checkpoints after commits of three generations, of which only the newest counts."""
    rows = _log(s, d)
    return sinks.committed(rows.groupBy("stream", "part", (F.col("seq") % 3).alias("generation")).agg(F.max("off").alias("off")).filter("generation < 2 or part < 4"))


SNK_GENERATIONS = _LOG + ", g AS (SELECT stream, part, seq % 3 AS generation, max(off) AS off FROM log WHERE seq % 3 < 2 OR part < 4 GROUP BY 1, 2, 3) SELECT stream, part, max(generation) AS generation, arg_max(off, generation) AS off FROM g GROUP BY 1, 2"


def stm_sink(s, d):
    """Events through a stream into the sink, run again from its checkpoint."""
    path, state = fresh(s, "sink"), fresh(s, "sink-state")
    for _ in range(2):
        rows = stream.read(s, d, "events").select(F.col("event_type").alias("stream"), (F.col("user_id") % 4).cast("int").alias("part"), F.col("event_id").cast("long").alias("off"), "props")
        sinks.sunk(rows, path, state)
    return s.read.parquet(path).select("stream", F.col("part").cast("int").alias("part"), "off", "props")


STM_SINK = "SELECT event_type AS stream, CAST(user_id % 4 AS INTEGER) AS part, event_id AS off, props FROM events"


def snk_json_lines(s, d):
    return sinks.exported(_rows(s, d), fresh(s, "json"), "json")


SNK_JSON_LINES = _LOG + " SELECT stream, part, off, subject, payload FROM log"


def snk_csv(s, d):
    """Grouped figures as CSV."""
    rows = _log(s, d).groupBy("stream", "part").agg(F.count("*").alias("ops"), F.sum("bytes").alias("bytes"))
    return sinks.exported(rows, fresh(s, "csv"), "csv")


SNK_CSV = _LOG + " SELECT stream, part, count(*) AS ops, CAST(sum(bytes) AS BIGINT) AS bytes FROM log GROUP BY 1, 2"


def snk_backup_chain(s, d):
    """A full backup, an incremental one and a restore: per restored file, whether it is what is there now."""
    path, rows = fresh(s, "store"), _rows(s, d)
    rows.filter("part < 4").write.partitionBy("part").parquet(path)
    full = sinks.manifest(s, path).persist()
    n = full.count()  # the manifest as it was before the store grew: one row per file
    rows.filter("part >= 4").write.mode("append").partitionBy("part").parquet(path)
    now = sinks.manifest(s, path)
    more = sinks.incremental(now, full)
    chain = full.withColumn("position", F.lit(0)).unionByName(more.withColumn("position", F.lit(1)))
    whole = sinks.restored(chain).join(now.withColumnRenamed("sha256", "now"), "path", "full")
    return whole.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("int").alias("part"), F.col("sha256").eqNullSafe(F.col("now")).alias("same")).distinct().withColumn("had_full", F.lit(n > 0))


SNK_BACKUP_CHAIN = _LOG + " SELECT DISTINCT part, true AS same, true AS had_full FROM log"


def snk_chain_links(s, d):
    """Backups that don't name their predecessor: orders as backups of 40 chains."""
    from pyspark.sql import Window

    o = ev.table(s, d, "orders").select((F.col("o_custkey") % 40).alias("chain"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("backup_id"))
    parent = F.lag("backup_id").over(Window.partitionBy("chain").orderBy("position"))
    return sinks.broken_links(o.withColumn("parent_id", F.when(F.col("position") % 50 == 7, -1).otherwise(parent))).select("chain", "position")


SNK_CHAIN_LINKS = "SELECT o_custkey % 40 AS chain, o_orderkey AS position FROM orders WHERE o_orderkey % 50 = 7"

ALL = {f.__name__: (f, globals()[f.__name__.upper()]) for f in (snk_append_once, snk_generations, stm_sink, snk_json_lines, snk_csv, snk_backup_chain, snk_chain_links)}


def queries() -> dict:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in ALL.items()}
