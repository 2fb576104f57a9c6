"""Positions and running sums inside groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.session import written

BUCKET_BITS = 12


def running_sum_by_hash(
    df: DataFrame, groups: list[str], key: str, tie: list[str], weight: str, out: str, bits: int = BUCKET_BITS
) -> DataFrame:
    """``out`` = sum of ``weight`` over the group's rows that come earlier by (hash ``key``, ``tie``).

    ``key`` is a uniform 64-bit hash. Its top bits cut each group into 2**bits
    buckets; only the buckets' totals (at most 2**bits rows per group) meet in
    one task, the rows themselves are ordered inside their bucket. A group of
    any size is therefore spread over 2**bits tasks' worth of keys, and rows
    are shuffled once. Null groups form a group of their own.
    """
    spot = [f"__g{i}" for i in range(len(groups))] + ["__bucket"]
    keyed = df.withColumns(
        {**{f"__g{i}": F.struct(F.col(g)) for i, g in enumerate(groups)}, "__bucket": F.shiftrightunsigned(F.col(key), 64 - bits)}
    )
    totals = keyed.groupBy(*spot).agg(F.sum(F.col(weight)).alias("__total"))
    earlier = W.partitionBy(*spot[:-1]).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*spot, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    inside = W.partitionBy(*spot).orderBy(key, *tie).rowsBetween(W.unboundedPreceding, -1)
    return (
        keyed.join(offsets, spot)
        .withColumn(out, F.col("__offset") + F.coalesce(F.sum(F.col(weight)).over(inside), F.lit(0)))
        .drop(*spot, "__offset")
    )


def average_ranks(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Average rank (1 = highest) of every distinct ``value`` of every group, for groups of any size.

    Returns (groups, value, out). Equal values are counted before they are
    shuffled; the distinct values are range-partitioned over (groups, value),
    so a group of any size spans as many partitions as it needs, and only one
    total per group and partition meets in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(
        counts.repartitionByRange(n, *groups, F.col(value).desc()).withColumn("__part", F.spark_partition_id())
    )
    totals = ranged.groupBy(*groups, "__part").agg(F.sum("__n").alias("__total"))
    before = W.partitionBy(*groups).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*groups, "__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy(*groups, "__part").orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, -1)
    return ranged.join(offsets, [*groups, "__part"]).select(
        *groups,
        value,
        (F.col("__offset") + F.coalesce(F.sum("__n").over(inside), F.lit(0)) + (F.col("__n") + 1) / 2).alias(out),
    )
