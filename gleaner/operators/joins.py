"""Joins with a table of keys that many rows may share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
BROADCAST_CHARACTERS = 30_000_000


def lookup_join(rows: DataFrame, table: DataFrame, key: str, spread: Column | str, how: str = "left", salts: int = 16) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per ``key``).

    A small table, by a count of at most BROADCAST_ROWS rows and
    BROADCAST_CHARACTERS characters as text, is broadcast. A larger
    one is repeated ``salts`` times and joined by (key, salt), the salt of a row
    taken from its column ``spread``, so that a key shared by a third of all
    rows is spread over as many tasks.
    """
    whole = F.length(F.to_json(F.struct(*table.columns)))
    size = table.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(whole), F.lit(0)).alias("characters")).first()
    if size["rows"] <= BROADCAST_ROWS and size["characters"] <= BROADCAST_CHARACTERS:
        return rows.join(F.broadcast(table), key, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    repeated = table.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(repeated, [key, "__salt"], how).drop("__salt")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time; null if there is none.

    Both sides are merged into one ordering per key: one shuffle, no pairs.
    """
    from pyspark.sql import Window as W

    a = left.withColumns({"__time": F.col(left_time), "__side": F.lit(1)})
    b = right.select(key, F.col(right_time).alias("__time"), F.lit(0).alias("__side"), F.struct(*values).alias("__values"))
    last = F.last("__values", ignorenulls=True).over(W.partitionBy(key).orderBy("__time", "__side").rowsBetween(W.unboundedPreceding, 0))
    merged = a.unionByName(b, allowMissingColumns=True).withColumn("__last", last).where("__side = 1")
    return merged.select(*left.columns, *(F.col("__last")[v].alias(f"last_{v}") for v in values))


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Points with every range [start, end) that holds them, by buckets of ``width``; ranges spanning many buckets are repeated."""
    p = points.withColumn("__bucket", F.floor(F.col(point) / width).cast("long"))
    r = ranges.where(F.col(start) < F.col(end)).withColumn(
        "__bucket", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long")))
    )
    return p.join(r, "__bucket").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__bucket")
