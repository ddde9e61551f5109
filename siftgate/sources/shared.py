"""The folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset in a local session, in a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftgate-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files and broadcasts of finished steps (its cleaner follows the garbage collector)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder. A cached frame stands with its whole plan in every plan that reads it, caches within caches
    included, and the driver holds each of these plans; of a table there is a scan."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
