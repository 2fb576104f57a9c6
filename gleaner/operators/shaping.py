"""Nested and pivoted results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ranking import SCOPE

#: Kinds of group whose head keeps its other members as children.
WITH_CHILDREN = ["parent", "location", "same_answer", "similar_answer"]


def fact_answer(formatted: Column, answer: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(formatted), F.lit("")), F.trim(answer), F.lit(""))


def facts(hits: DataFrame) -> DataFrame:
    """(scope, rank, fact): one JSON object per group, with its head's fields and its other members as children in order.

    Hits have group_id, kind, group_rank and place. Only kinds in WITH_CHILDREN keep children.
    """
    own = F.struct("place", "hit_id", F.coalesce("match_text", F.lit("")).alias("phrase"), fact_answer(F.col("formatted_answer"), F.col("answer")).alias("answer"))
    groups = hits.groupBy(*SCOPE, "group_id", "group_rank", "kind").agg(F.array_sort(F.collect_list(own)).alias("members"))
    head = F.get("members", F.lit(0))
    children = F.when(F.col("kind").isin(*WITH_CHILDREN), F.expr("slice(members, 2, size(members))")).otherwise(F.expr("slice(members, 1, 0)"))
    fact = F.struct(
        head["hit_id"].alias("hit_id"),
        head["phrase"].alias("phrase"),
        head["answer"].alias("answer"),
        F.col("kind").alias("group_type"),
        F.transform(children, lambda c: F.struct(c["hit_id"].alias("hit_id"), c["answer"].alias("answer"))).alias("children"),
    )
    return groups.select(*SCOPE, F.col("group_rank").alias("rank"), F.to_json(fact).alias("fact"))


def joined_answers(hits: DataFrame, separator: str = "/n") -> DataFrame:
    """(scope, answer): the answers of a scope's groups' heads in order, as one text."""
    heads = hits.where("place = 1")
    answers = F.transform(
        F.array_sort(F.collect_list(F.struct("group_rank", fact_answer(F.col("formatted_answer"), F.col("answer")).alias("a")))), lambda x: x["a"]
    )
    return heads.groupBy(*SCOPE).agg(F.array_join(F.filter(answers, lambda a: a != ""), separator).alias("answer"))


def grid(facts_of_topics: DataFrame, topics: list[str], value: str = "answer") -> DataFrame:
    """One row per file, one column per topic: the value of the topic's first fact in it. Rows have file_idx, topic, rank."""
    return facts_of_topics.groupBy("file_idx").pivot("topic", topics).agg(F.min_by(value, "rank"))


def with_summary(hits: DataFrame, summaries: DataFrame, place: int = 10_000, score: float = 0.99) -> DataFrame:
    """Hits and a synthetic one for every summary (scope, hit_id, match_text)."""
    extra = summaries.select(*SCOPE, "hit_id", "match_text", F.lit(place).alias("match_idx"), F.lit("summary").alias("block_type"), F.lit(score).alias("match_score"))
    return hits.unionByName(extra, allowMissingColumns=True)


def page(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


# The fields of a fact. Those of the first list have their own names in hits, scores come from other columns.
PLAIN_FIELDS = "match_idx page_idx block_type answer entity_types entity_list cross_references answer_details group_type bbox parent_text header_text hierarchy_headers summary_references criteria_uid file_idx file_name file_title file_meta".split()
SCORE_FIELDS = {
    "match_score": "match_score", "raw_match_score": "raw_match_score", "relevancy_score": "relevancy_score", "qa_score": "squad_score", "group_score": "group_score",
    "table_score": "table_score", "file_score": "file_score", "semantic_score": "sif_score", "boolq_score": "boolq_score", "retriever_raw_score": "cross_encoder_raw_score",
}
TERM_FIELDS = "match_text_terms match_semantic_terms header_text_terms header_semantic_terms hierarchy_headers_text_terms block_text_terms".split()
RELATION_FIELDS = "relation_head relation_tail relation_head_prob relation_tail_prob".split()


def fact_fields(hits: DataFrame, is_question: Column) -> DataFrame:
    """One flat row of a fact's fields for every hit; what hits have no column for is null, 0 or an empty list.

    A heading's phrase is its own text, a missing formatted answer is the
    answer, the retriever's score is the cross-encoder's where there is one, else the
    entailment's, a table is what was read from it, else the whole. The scaled
    score is only shown for questions. ``uniq_id`` hashes criterion, hit and answers.
    """
    held = set(hits.columns)
    column = lambda name, kind="string": F.col(name) if name in held else F.lit(None).cast(kind)
    score = lambda name: F.coalesce(F.nanvl(column(name, "double"), F.lit(None).cast("double")), F.lit(0.0))
    formatted = F.coalesce(column("formatted_answer"), column("answer"))
    fields = {name: column(name) for name in [*PLAIN_FIELDS, *RELATION_FIELDS]}
    fields |= {name: score(source) for name, source in SCORE_FIELDS.items()}
    fields |= {name: F.coalesce(column(name, "array<string>"), F.array().cast("array<string>")) for name in TERM_FIELDS}
    fields |= {
        "formatted_answer": formatted,
        "phrase": F.when(F.col("block_type") == "header", F.coalesce(column("block_text"), column("match_text"))).otherwise(column("match_text")),
        "table": F.coalesce(F.nullif(column("table_answer"), F.lit("")), column("table")),
        "table_all": column("table"),
        "retriever_score": F.coalesce(column("cross_encoder_score", "double"), score("qnli_score")),
        "scaled_score": F.when(is_question, column("scaled", "double") if "scaled" in held else column("scaled_score", "double")),
        "criteria_question": column("question"),
        "is_override": F.lit(False),
        "uniq_id": F.xxhash64(F.concat_ws(":", column("criteria_uid"), F.col("hit_id").cast("string"), F.coalesce(column("answer"), F.lit("")), F.coalesce(formatted, F.lit("")))),
    }
    return hits.select("hit_id", *(c.alias(n) for n, c in fields.items()))
