"""Streams: incremental extraction and windowed counts, each equal to its batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, path: str, like: DataFrame, max_files: int = 64) -> DataFrame:
    """Parquet files as a stream with the schema of ``like``; a path with a wildcard may also be a single file."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max_files).parquet(path)


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Timestamps without zone can't carry a watermark."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    rows = timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "1 day", step: str = "12 hours", late: str = "1 hour") -> DataFrame:
    rows = timed(events).withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return rows.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key's first event only; keys are forgotten behind the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Give all that is there to ``sink`` batch by batch, then stop; a restart goes on where the last run ended."""
    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
