"""A folder that all machines share, for tables that a plan writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``, deleted when the driver's JVM ends. Only a local session may lack that setting; it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='rillmark-')}"
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}")
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    parent = files.makeQualified(path.getParent()).toString()
    files.mkdirs(sc._jvm.org.apache.hadoop.fs.Path(parent))
    outer = sc._jvm.org.apache.hadoop.fs.Path(f"{parent.rstrip('/')}/{path.getName()}")
    files.mkdirs(outer)  # what isn't there can't be marked
    files.deleteOnExit(outer)
    return f"{outer.toString()}/data"
