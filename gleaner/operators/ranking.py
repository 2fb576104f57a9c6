"""Ranking of hits and of groups of hits. Scope is (criteria_uid, file_idx)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCOPE = ["criteria_uid", "file_idx"]
DEFAULTS = {"qnli_score": 1.0, "squad_score": 1.0, "boolq_score": 1.0, "relevancy_score": 0.5, "match_score": 0.0, "file_score": 0.0, "table_score": 0.0, "group_score": 1.0, "scaled_score": 1.0}
BACKWARD_BLOCKS = ["list_item", "table", "header_summary"]


def with_default_scores(hits: DataFrame) -> DataFrame:
    """Missing scores, and a match_score of -1 or NaN, become their defaults."""
    columns = {}
    for name, value in DEFAULTS.items():
        if name in hits.columns:
            score = F.col(name)
            unset = score.isNull() | F.isnan(score) | ((score == -1) if name == "match_score" else F.lit(False))
            columns[name] = F.when(unset, value).otherwise(score)
        else:
            columns[name] = F.lit(value)
    return hits.withColumns(columns)


def scaled_score(is_table: Column, cross_encoder: Column | None = None) -> Column:
    """Product of the scores of a hit; a match counts 0.2 at least, a table also by relevancy and table score.

    With a cross-encoder its score stands for the match.
    """
    base = F.greatest(F.col("match_score"), F.lit(0.2)) if cross_encoder is None else cross_encoder
    product = F.col("scaled_score") * base * F.col("boolq_score") * F.col("squad_score") * F.col("qnli_score") * F.col("group_score")
    return F.when(is_table, product * F.col("relevancy_score") * F.col("table_score")).otherwise(product)


def has_text(answer: Column) -> Column:
    return F.coalesce(F.trim(answer) != "", F.lit(False))


def ranked_groups(hits: DataFrame) -> DataFrame:
    """(scope, group_id, group_rank, group_best): groups with an answer first, then by the best scaled score of their answered, else of all hits."""
    answered = has_text(F.col("answer"))
    groups = hits.groupBy(*SCOPE, "group_id").agg(
        F.bool_or(answered).alias("any_answer"), F.coalesce(F.max(F.when(answered, F.col("scaled"))), F.max("scaled")).alias("group_best")
    )
    order = W.partitionBy(*SCOPE).orderBy(F.col("any_answer").desc(), F.col("group_best").desc(), "group_id")
    return groups.select(*SCOPE, "group_id", "group_best", F.row_number().over(order).alias("group_rank"))


def ranked_in_groups(hits: DataFrame) -> DataFrame:
    """Hits with ``place`` in their group: parents first, lists and tables in order of place, others answered first, then by score."""
    backward = F.col("block_type").isin(*BACKWARD_BLOCKS)
    second = F.when(backward, -F.col("match_idx")).otherwise(has_text(F.col("answer")).cast("int"))
    order = [(F.col("oid") == F.col("parent_oid")).desc_nulls_last(), second.desc(), F.col("scaled").desc(), F.col("hit_id")]
    return hits.withColumn("place", F.row_number().over(W.partitionBy(*SCOPE, "group_id").orderBy(*order)))


def once_per_answer(hits: DataFrame) -> DataFrame:
    """Hits with ``repeated``: whether an earlier hit of the group has the same answer."""
    spot = W.partitionBy(*SCOPE, "group_id", F.lower(F.trim("answer"))).orderBy(F.col("scaled").desc(), "hit_id")
    return hits.withColumn("repeated", has_text(F.col("answer")) & (F.row_number().over(spot) > 1))


def _clamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scope = group = None
    latest = head = 1.0
    for batch in batches:
        clamped = []
        keys = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
        for criteria, file, group_rank, _, score in keys:
            if (criteria, file) != scope:
                scope, group, latest = (criteria, file), None, 1.0
            if group_rank != group:
                if group is not None:
                    latest = head
                group, head = group_rank, None
            if latest < score:
                score = max(0.0, latest - 0.01)
            latest = score
            if head is None:
                head = score
            clamped.append(score)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clamped, pa.float64())], names=[*batch.schema.names, "clamped"])


def clamped_scores(hits: DataFrame) -> DataFrame:
    """(scope, group_rank, place, scaled, hit_id, clamped): scores that never rise within a group, nor from a group's head to the next one's.

    A score over the one before it becomes that one less 0.01, 0 at least. An
    ordered fold: it runs over sorted partitions as a stream, whatever their size.
    """
    rows = hits.select(*SCOPE, "group_rank", "place", "scaled", "hit_id")
    ordered = rows.repartition(*SCOPE).sortWithinPartitions(*SCOPE, "group_rank", "place")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", clamped double"
    return ordered.mapInArrow(_clamp, schema)


def list_answers(hits: DataFrame) -> DataFrame:
    """(scope, group_id, answers): the answers of a list's items behind its head, in order, joined by '; '."""
    items = hits.where((F.col("block_type") == "list_item") & has_text(F.col("answer")) & (F.col("place") > 1))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hit_id", "answer"))), lambda x: F.trim(x["answer"])), "; ")
    return items.groupBy(*SCOPE, "group_id").agg(joined.alias("answers"))


def final_ranks(hits: DataFrame) -> DataFrame:
    """Hits with ``rank`` in their scope: summaries first, then by group and place, those without group_rank last."""
    summary = (F.coalesce("block_type", F.lit("")) == "summary").desc()
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(*SCOPE).orderBy(summary, F.col("group_rank").asc_nulls_last(), "place", "hit_id")))


def file_order(hits: DataFrame, by_file_score: bool = True) -> DataFrame:
    """(criteria_uid, file_idx, position): files by answer, then by file score and best match times relevancy (or the other way round)."""
    files = hits.groupBy(*SCOPE).agg(
        F.bool_or(has_text(F.col("answer"))).alias("any_answer"),
        F.max("file_score").alias("file_best"),
        F.round(F.max(F.col("match_score") * F.col("relevancy_score")), 6).alias("match_best"),
    )
    scores = ["file_best", "match_best"] if by_file_score else ["match_best", "file_best"]
    order = W.partitionBy("criteria_uid").orderBy(F.col("any_answer").desc(), *(F.col(s).desc() for s in scores), "file_idx")
    return files.select(*SCOPE, F.row_number().over(order).alias("position"))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with ``rank``; rows beyond them are dropped before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)
