"""Streaming, an addition of ours: changed files as a stream, and windowed counts of events."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reextract(spark: SparkSession, folder: str, schema: str, extract: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Extract each new file's rows once: a file-source stream, written per micro-batch under its number, so a batch that runs again
    overwrites what it wrote before."""
    rows = spark.readStream.schema(schema).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        extract(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per type and window; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
