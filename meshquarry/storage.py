"""The shared folder, and what is kept there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`. Only where that is unset and Spark runs on one
    machine, as in local tests, a temporary one; on a cluster it must be set."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", None):
        return found
    if not (held := sc._jsc.sc().getCheckpointDir()).isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder; lineage ends there. Spark's cleaner deletes the files when
    the frame is no longer referenced (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for one table or state. What is written there is deleted when the session's driver
    ends."""
    folder = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{folder}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), as compressed Parquet, for wide rows."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
