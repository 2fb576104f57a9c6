"""Contexts for summaries within a token budget, and an extractive summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators.ranking import SCOPE, has_text

BUDGET, CANDIDATES = 3_000, 25


def sentence(header: Column, text: Column) -> Column:
    """Heading and text, ended by a full stop unless there is a mark already."""
    joined = F.concat_ws(": ", F.nullif(F.trim(header), F.lit("")), F.nullif(F.trim(text), F.lit("")))
    return F.when(joined == "", "").when(F.regexp_like(joined, F.lit("[.!?;:,]$")), joined).otherwise(F.concat(joined, F.lit(".")))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def candidates(hits: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The first ``most`` hits of each scope: answered ones first, then by boolq times squad score, then by match."""
    score = F.coalesce("boolq_score", F.lit(1.0)) * F.coalesce("squad_score", F.lit(1.0))
    order = [has_text(F.col("answer")).desc(), F.round(score, 6).desc(), F.coalesce("raw_match_score", F.lit(0.0)).desc(), F.col("hit_id")]
    return hits.withColumn("turn", F.row_number().over(W.partitionBy(*SCOPE).orderBy(*order))).where(F.col("turn") <= most)


def within_budget(hits: DataFrame, budget: int = BUDGET, most: int = CANDIDATES, count: Callable[[Column], Column] = n_words) -> DataFrame:
    """(scope, turn, hit_id, text, used): the candidates' sentences up to the first that passes the budget."""
    rows = candidates(hits, most).withColumn("text", sentence(F.col("header_text"), F.col("match_text"))).where("text <> ''")
    running = F.sum(count(F.col("text"))).over(W.partitionBy(*SCOPE).orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return rows.select(*SCOPE, "turn", "hit_id", "text", running.alias("used")).where(F.col("used") < budget)


def extractive_summary(contexts: DataFrame, sentences: int = 3) -> DataFrame:
    """(scope, summary): the first sentences of each scope's contexts, the offline stand-in for a language model."""
    first = contexts.where(F.col("turn") <= sentences)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return first.groupBy(*SCOPE).agg(text.alias("summary"))


def with_references(contexts: DataFrame, definitions: DataFrame, budget: int = BUDGET, count: Callable[[Column], Column] = n_words) -> DataFrame:
    """Contexts (scope, text) behind which the definitions (file_idx, key, text) of the terms they name are put, unless that passes the budget.

    A term counts only as whole words; one that lies inside a longer named term doesn't count; a text already there isn't repeated.
    """
    keyed = contexts.join(definitions.select("file_idx", "key", F.col("text").alias("definition")), "file_idx")
    bounded = F.regexp_like(F.col("text"), F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_-])\Q"), F.col("key"), F.lit(r"\E(?![\p{L}\p{N}_-])")))
    named = keyed.where(bounded & ~F.contains("text", "definition")).groupBy(*SCOPE, "text").agg(F.collect_set(F.struct("key", "definition")).alias("found"))
    outer = F.filter("found", lambda x: ~F.exists("found", lambda y: (F.length(y["key"]) > F.length(x["key"])) & F.contains(F.lower(y["key"]), F.lower(x["key"]))))
    extra = F.array_join(F.array_distinct(F.transform(F.array_sort(outer), lambda x: x["definition"])), "\n")
    joined = contexts.join(named.select(*SCOPE, "text", extra.alias("__extra")), [*SCOPE, "text"], "left")
    longer = F.concat_ws("\n", "text", "__extra")
    fits = F.col("__extra").isNotNull() & (count(longer) <= budget)
    return joined.withColumn("text", F.when(fits, longer).otherwise(F.col("text"))).drop("__extra")
