"""Grouping of hits that state the same fact. Hits have hit_id and the columns named below; scope is (criteria_uid, file_idx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.graph import connected_components
from gleaner.operators.joins import lookup_join
from gleaner.session import written

SCOPE = ["criteria_uid", "file_idx"]


def merged_by_passage(hits: DataFrame, key: list[str]) -> DataFrame:
    """One hit per key: with answer first, then lower criteria rank, higher squad, higher boolq score, lower hit_id."""
    order = [F.col("has_answer").desc_nulls_last(), F.col("criteria_rank"), F.col("squad_score").desc_nulls_last(), F.col("boolq_score").desc_nulls_last(), F.col("hit_id")]
    return hits.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def parent_groups(hits: DataFrame) -> DataFrame:
    """(hit_id, group_id, group_type, group_size): hits of one parent; the group is named after its earliest hit and has its type."""
    first = hits.groupBy(*SCOPE, "parent_oid").agg(
        F.min(F.struct("match_idx", "hit_id", "group_type")).alias("f"), F.count(F.lit(1)).alias("group_size")
    )
    joined = hits.select("hit_id", *SCOPE, "parent_oid").join(first, [*SCOPE, "parent_oid"])
    return joined.select("hit_id", F.col("f.hit_id").alias("group_id"), F.col("f.group_type").alias("group_type"), "group_size")


def answer_key(answer: Column) -> Column:
    """An answer's words in lower case, by which answers are the same; null if it has none."""
    return F.nullif(F.array_join(T.tokens(answer), " "), F.lit(""))


def same_answer_groups(hits: DataFrame) -> DataFrame:
    """(hit_id, group_id, group_size): hits of a scope with the same answer words; hits without answer are in none."""
    keyed = hits.select("hit_id", *SCOPE, answer_key(F.col("answer")).alias("__key")).where("__key is not null")
    groups = keyed.groupBy(*SCOPE, "__key").agg(F.min("hit_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return keyed.join(groups, [*SCOPE, "__key"]).select("hit_id", "group_id", "group_size")


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets of words, a stand-in for embeddings."""
    return F.size(F.array_intersect(a, b)) / F.sqrt((F.size(a) * F.size(b)).cast("double"))


def location_edges(hits: DataFrame, reach: int = 3, least: float = 0.5) -> DataFrame:
    """(a, b): answered hits of one scope, heading and block at most ``reach`` places apart with similar texts.

    Each hit looks back at the hits of the ``reach`` places before it and at those
    of its own place, so no pairs of a whole scope are made.
    """
    words = hits.where("answer is not null and trim(answer) <> ''").select(
        "hit_id", *SCOPE, "match_idx", "block_type", F.coalesce("header_text", F.lit("")).alias("header"), F.array_distinct(T.tokens(F.col("match_text"))).alias("words")
    )
    spot = W.partitionBy(*SCOPE, "block_type", "header").orderBy("match_idx").rangeBetween(-reach, 0)
    behind = words.where("match_idx is not null").select("hit_id", "match_idx", "words", F.collect_list(F.struct("hit_id", "match_idx", "words")).over(spot).alias("behind"))
    pairs = behind.select("hit_id", "match_idx", "words", F.explode("behind").alias("o"))
    near = pairs.where("(o.match_idx < match_idx or o.hit_id < hit_id) and size(words) > 0 and size(o.words) > 0")
    return near.where(token_cosine(F.col("words"), F.col("o.words")) > least).select(F.least("hit_id", "o.hit_id").alias("a"), F.greatest("hit_id", "o.hit_id").alias("b"))


def similar_edges(hits: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b): hits of one scope whose answers differ but have similar words; equal answers are represented by their lowest hit.

    Answers meet only over one of their rarest words: as many of them as leave
    too few for the cosine.
    """
    answers = hits.select("hit_id", *SCOPE, F.array_sort(F.array_distinct(T.tokens(F.col("answer")))).alias("words")).where(F.size("words") > 0)
    once = written(answers.groupBy(*SCOPE, "words").agg(F.min("hit_id").alias("hit_id")))
    each = once.select(*SCOPE, "hit_id", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ordered = lookup_join(each, counts, "word", "hit_id", "inner").groupBy(*SCOPE, "hit_id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("o"))
    distinct = ordered.select(*SCOPE, "hit_id", F.col("o.word").alias("words"))
    needed = F.ceil(F.size("words") * least * least - 1e-9)
    first = distinct.withColumn("word", F.explode(F.slice("words", F.lit(1), (F.size("words") - needed + 1).cast("int"))))
    other = first.select(*SCOPE, "word", F.col("hit_id").alias("b"), F.col("words").alias("bw"))
    pairs = first.join(other, [*SCOPE, "word"]).where("hit_id < b").select(F.col("hit_id").alias("a"), "b", "words", "bw").distinct()
    return pairs.where(token_cosine(F.col("words"), F.col("bw")) > least).select("a", "b")


def component_groups(edges: DataFrame) -> DataFrame:
    """(hit_id, group_id, group_size) of the connected parts of an edge table."""
    parts = connected_components(edges)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("group_size"))
    return parts.join(sizes, "component").select(F.col("node").alias("hit_id"), F.col("component").alias("group_id"), "group_size")


def grouped(hits: DataFrame) -> DataFrame:
    """(hit_id, group_id, kind): each hit in one group: parent, then location, same answer, similar answer, else alone.

    Each step takes only hits that the steps before left over; groups of one
    and location groups with a heading or table stay open for the next step.
    Hits whose criterion has group_flag 'disable' are alone.
    """
    columns = ["hit_id", *SCOPE, "oid", "parent_oid", "match_idx", "block_type", "group_type", "header_text", "match_text", "answer", "group_flag"]
    hits = written(hits.select(*columns))  # read by every step
    open_hits = hits.where("coalesce(group_flag, '') <> 'disable'")
    taken = written(parent_groups(open_hits).where("group_size > 1").select("hit_id", "group_id", F.lit("parent").alias("kind")))
    left = written(open_hits.join(taken.select("hit_id"), "hit_id", "left_anti"))
    located = written(component_groups(location_edges(left)))
    mixed = located.join(left.where("block_type in ('header', 'table')").select("hit_id"), "hit_id").select("group_id").distinct()
    located = written(located.join(mixed, "group_id", "left_anti").select("hit_id", "group_id", F.lit("location").alias("kind")))
    left = written(left.join(located.select("hit_id"), "hit_id", "left_anti"))
    same = written(same_answer_groups(left).select("hit_id", "group_id", F.lit("same_answer").alias("kind")))
    left = left.join(same.select("hit_id"), "hit_id", "left_anti")
    similar = written(component_groups(similar_edges(left)).select("hit_id", "group_id", F.lit("similar_answer").alias("kind")))
    found = taken.unionByName(located).unionByName(same).unionByName(similar)
    alone = hits.join(found.select("hit_id"), "hit_id", "left_anti").select("hit_id", F.col("hit_id").alias("group_id"), F.lit("single").alias("kind"))
    return found.unionByName(alone)


def down_weighted(group_score: Column, is_same_answer: Column, any_same_answer: Column, most: float = 0.9) -> Column:
    """Where a scope has a group of same answers, the other hits count less."""
    return F.when(any_same_answer & ~is_same_answer, F.least(group_score, F.lit(most))).otherwise(group_score)
