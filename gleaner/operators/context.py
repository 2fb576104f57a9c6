"""Text around a passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1_000


def context_window(hits: DataFrame, passages: DataFrame, before: str, after: str, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """``hits`` with ``context``: the texts of the passages from ``before`` places ahead of a hit to ``after`` behind it.

    Both have file_idx and match_idx, passages also match_text; before and
    after are columns of hits; ``most`` is the largest of their values, looked up
    if it isn't given. Null and negative ones count as 0. Files are cut into blocks of
    ``block`` places, and the passages near an edge are given to all blocks they
    reach, so that a file of any length is spread. Missing places, null and empty texts
    are left out; a hit without file or place has the context ''.
    """
    back, ahead = (F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in (before, after))
    if most is None:
        most = hits.agg(F.max(F.greatest(back, ahead))).first()[0] or 0
    spot = F.floor(F.col("match_idx") / block)
    texts = passages.where("file_idx is not null and match_idx is not null").select("file_idx", "match_idx", "match_text")
    near = F.sequence(F.floor((F.col("match_idx") - most) / block), F.floor((F.col("match_idx") + most) / block))
    spread = texts.withColumn("__block", F.explode(near)).withColumn("__own", F.col("__block") == spot)
    frame = W.partitionBy("file_idx", "__block").orderBy("match_idx").rangeBetween(-most, most)
    filled = F.col("match_text").isNotNull() & (F.col("match_text") != "")
    around = spread.withColumn("__around", F.collect_list(F.when(filled, F.struct("match_idx", "match_text"))).over(frame)).where("__own")
    own = around.select("file_idx", "match_idx", "__around").dropDuplicates(["file_idx", "match_idx"])
    joined = hits.join(own, ["file_idx", "match_idx"], "left")
    kept = F.filter(
        F.col("__around"),
        lambda x: (x["match_idx"] >= F.col("match_idx") - back) & (x["match_idx"] <= F.col("match_idx") + ahead),
    )
    text = F.array_join(F.transform(F.array_sort(kept), lambda x: x["match_text"]), " ")
    return joined.withColumn("context", F.coalesce(text, F.lit(""))).drop("__around")


def with_parent(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """``hits`` with ``parent_text``: the text of the passage whose oid is parent_oid, null if there is none."""
    parents = passages.select(F.col("oid").alias("parent_oid"), F.col("match_text").alias("parent_text")).dropDuplicates(["parent_oid"])
    return hits.join(parents, "parent_oid", "left")


def hierarchy_headers(chain: Column, text: str = "block_text") -> Column:
    """The texts of a passage's level chain (array of structs, nearest first) from the outermost heading on."""
    return F.reverse(F.transform(chain, lambda level: level[text]))


def qa_text(block_type: Column, header: Column, text: Column, parent: Column, is_child: Column) -> Column:
    """What a question is put to: a table's heading, a child behind its parent, other text behind its heading."""
    body, head, above = (F.coalesce(c, F.lit("")) for c in (text, header, parent))
    ending = F.regexp_replace(above, r"[.,!?]+$", "")
    return (
        F.when(F.coalesce(block_type == "table", F.lit(False)), head)
        .when(is_child & (above != ""), F.concat(ending, F.lit(": "), body))
        .when(head != "", F.concat(head, F.lit(": "), body))
        .otherwise(body)
    )


def expand_children(hits: DataFrame, passages: DataFrame, score: str) -> DataFrame:
    """Hits and the children of parents that are no paragraphs, each passage once.

    A child takes over its parent's score; where it is a hit itself, its own
    score wins, and it is linked to its best-scoring parent.
    """
    own = hits.select("oid", F.col(score).alias("__score"), F.lit(True).alias("__own"), F.lit(None).cast("string").alias("via"))
    parents = hits.where("block_type <> 'para'").select(F.col("oid").alias("parent_oid"), F.col(score).alias("__score"))
    children = (
        passages.where("parent_oid <> oid").select("oid", "parent_oid").join(parents, "parent_oid")
        .select("oid", "__score", F.lit(False).alias("__own"), F.col("parent_oid").alias("via"))
    )
    every = own.unionByName(children).groupBy("oid").agg(
        F.max(F.struct("__own", "__score")).alias("best"),
        F.max(F.when(~F.col("__own"), F.struct("__score", "via"))).alias("link"),
    )
    return every.select("oid", F.col("best.__score").alias(score), F.col("best.__own").alias("direct"), F.col("link.via").alias("via"))
