"""Sinks of extracted fields and readers of other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_any(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, JSON, CSV or text; schemas are given rather than inferred."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def overwrite_field(facts: DataFrame, path: str, partitions: list[str]) -> None:
    """Replace the facts of the fields in ``facts``; the partitions of other fields stay."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def append_field(facts: DataFrame, path: str, batch: str, partitions: list[str]) -> None:
    """Append a batch's facts; a batch delivered again replaces itself."""
    marked = facts.withColumn("batch_idx", F.lit(batch))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch_idx").parquet(path)


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def page_of_files(files: DataFrame, workspace: str, size: int = 20, offset: int = 0) -> DataFrame:
    """A page of a workspace's files by name."""
    return files.where(F.col("workspace_idx") == workspace).orderBy("file_name", "file_idx").offset(offset).limit(size)
