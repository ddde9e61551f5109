"""Structured Streaming over files of events: windows, sessions and repeats, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path

LATE = "2 hours"


def source(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of ``events``, with ``ts`` as timestamp and a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r
    return r.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def windows(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def settled(stream: DataFrame) -> DataFrame:
    """Runs an aggregate over all files that are there and returns its last state. Each batch's state is a table in the
    shared folder, so a lost executor or a restart repeats a batch and not the stream."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    last = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state-{number}")
        last.append(number)

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/state-{last[-1]}")
