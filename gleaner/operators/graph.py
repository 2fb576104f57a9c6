"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, component): component is the smallest node of the connected part.

    Alternating star contraction: each node's larger neighbours are hung on its
    smallest neighbour, then its smaller neighbours likewise, until nothing
    changes; O(log nodes) rounds of one aggregation and one join each. Null
    ends and loops are ignored (a node with only a loop forms its own part).
    Each round is written, so lost executors cost one round.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct()
    current = written(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = written(hung.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return nodes.join(current, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
