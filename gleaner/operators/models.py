"""Scores by models: an interface, and offline stand-ins that need no model files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import text as T


class Scorer(Protocol):
    """Scores (question, sentence) pairs; runs in Python workers, one instance per task."""

    def __call__(self, question: str, sentence: str) -> float: ...


def model_column(make: Callable[[], Scorer]) -> Callable[[Column, Column], Column]:
    """A column function from a factory of scorers; the model is made once per task, pairs come in Arrow batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for questions, sentences in batches:
            yield pd.Series([model(q or "", s or "") for q, s in zip(questions, sentences, strict=True)], dtype="float64")

    return score


def overlap_score(question: Column, sentence: Column) -> Column:
    """Stand-in for entailment and cross-encoder scores: the share of the question's words found in the sentence."""
    wanted = F.array_distinct(T.without(T.tokens(question), T.STOP_WORDS))
    held = F.array_distinct(T.tokens(sentence))
    share = F.size(F.array_intersect(wanted, held)) / F.size(wanted)
    return F.coalesce(F.when(F.size(wanted) > 0, share), F.lit(0.0))


# What questions with such openings ask for; the first that fits counts.
ANSWER_TYPES: list[tuple[str, str]] = [
    ("NUM:count", r"^how many\b"),
    ("NUM:period", r"^how (?:long|often)\b|\b(?:term|period|duration)\b"),
    ("NUM:perc", r"\b(?:percent|percentage|rate|share)\b"),
    ("NUM:money", r"^how much\b|\b(?:price|amount|balance|rent|fee|cost|value)\b"),
    ("NUM:date", r"^when\b|\b(?:date|day|year)\b"),
    ("HUM:ind", r"^(?:who|whom|whose)\b"),
    ("LOC:other", r"^where\b|\b(?:address|city|country|location)\b"),
    ("DESC:reason", r"^why\b"),
    ("DESC:manner", r"^how\b"),
]


def answer_type(question: Column) -> Column:
    """Stand-in for the classifier of expected answers: the first rule that fits; '' for yes-or-no questions and what isn't a question."""
    found = F.lit("ENTY:other")
    for kind, rule in reversed(ANSWER_TYPES):
        found = F.when(F.regexp_like(F.lower(question), F.lit(rule)), kind).otherwise(found)
    return F.when(T.is_question(question) & ~T.is_bool_question(question), found).otherwise(F.lit(""))


def question_keywords(question: Column) -> Column:
    """Stand-in for linguistic decomposition: the runs of content words of a question, the longest first, then in order of the alphabet."""
    cut = F.transform(T.tokens(question), lambda w: F.when(T.one_of(w, [*T.STOP_WORDS, *T.QUESTION_WORDS, *T.BOOL_QUESTION_WORDS]), "|").otherwise(w))
    runs = F.filter(F.transform(F.split(F.array_join(cut, " "), r"\|"), lambda r: F.trim(r)), lambda r: r != "")
    ordered = F.array_sort(F.transform(F.array_distinct(runs), lambda r: F.struct((-F.size(F.split(r, " "))).alias("n"), r.alias("r"))))
    return F.coalesce(F.transform(ordered, lambda s: s["r"]), F.array().cast("array<string>"))


def hashed_encoding(text: Column, d: int = 64) -> Column:
    """Stand-in for a sentence encoder: the text's words counted in ``d`` hashed places, of length 1; null without words."""
    words = T.tokens(text)
    place = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(d)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.size(F.filter(place, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.size(words) > 0, F.transform(counts, lambda x: (x / norm).cast("float")))


def best_span(question: Column, text: Column) -> Column:
    """Stand-in for span answering: (start_prob, answer), the sentence that holds most of the question's words, of equal ones the first."""
    sentences = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?;])\s+"), lambda s: F.trim(s) != "")
    scored = F.transform(sentences, lambda s, i: F.struct(overlap_score(question, s).alias("start_prob"), (-i).alias("i"), s.alias("answer")))
    best = F.array_max(scored)
    return F.when(F.size(sentences) > 0, F.struct(best["start_prob"].alias("start_prob"), best["answer"].alias("answer")))


def extraction_wanted(disabled_by_task: bool, ad_hoc: bool, disabled_by_workspace: bool, one_file: bool) -> bool:
    """Whether answers are extracted at all; a workspace's switch counts for ad-hoc requests about one file."""
    return not disabled_by_task and not (ad_hoc and disabled_by_workspace and one_file)


def boolean_answer(p_true: Column, p_false: Column, p_neutral: Column) -> Column:
    """Yes, No, or null if neutral is the likeliest."""
    return F.when((p_true >= p_false) & (p_true >= p_neutral), "Yes").when((p_false > p_true) & (p_false >= p_neutral), "No")


def scored_once(rows: DataFrame, text: str, model: Callable[[Column], Column], out: str) -> DataFrame:
    """``rows`` with ``out``, the model's value of ``text``; every distinct text is given to the model once."""
    values = rows.select(text).distinct().withColumn(out, model(F.col(text)))
    return rows.join(values, text, "left")


def best_per_file(hits: DataFrame, group: list[str], score: str, tie: list[str], keep: int = 5) -> DataFrame:
    """Hits with ``has_answer``: only the ``keep`` best of each group have one."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), *tie))
    best = hits.select(*group, *tie, score).withColumn("__rank", rank).where(F.col("__rank") <= keep)
    keys = list(dict.fromkeys([*group, *tie]))
    return hits.drop("has_answer").join(best.select(*keys, F.lit(True).alias("has_answer")), keys, "left").withColumn(
        "has_answer", F.coalesce("has_answer", F.lit(False))
    )


def picked_by_logit(labels: list[str], logits: list[Column], least: float = 0.6, default: str = "Other") -> Column:
    """The labels whose logit passes ``least``, sorted and comma-joined; the default if none does."""
    kept = F.array_sort(F.filter(F.array(*(F.when(x > least, label) for label, x in zip(labels, logits, strict=True))), lambda v: v.isNotNull()))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise(default)


def relation_questions(relation: Column) -> tuple[Column, Column]:
    """Questions for the head and the tail of a relation."""
    return F.concat(F.lit("who "), relation, F.lit("?")), F.concat(F.lit("what was the object of "), relation, F.lit("?"))


def as_triple(head: Column, tail: Column, head_score: Column, tail_score: Column, least: float = 0.3) -> Column:
    """A relation's ends where both were found with enough probability, else null."""
    found = (head_score >= least) & (tail_score >= least) & (F.coalesce(head, F.lit("")) != "") & (F.coalesce(tail, F.lit("")) != "")
    return F.when(found, F.struct(head.alias("head"), tail.alias("tail"), head_score.alias("head_prob"), tail_score.alias("tail_prob")))


def entity_answers(pairs: DataFrame, key: list[str], entity: str, answer: str) -> DataFrame:
    """(key, answer): the answers of a passage's entities as 'entity => answer; ...', by entity."""
    parts = F.array_sort(F.collect_set(F.concat(F.col(entity), F.lit(" => "), F.col(answer))))
    return pairs.where(f"{entity} is not null and coalesce({answer}, '') <> ''").groupBy(*key).agg(F.array_join(parts, "; ").alias(answer))


def near_words(words: DataFrame, asked: DataFrame, word: str = "word", least: float = 0.6) -> DataFrame:
    """(word, asked, similarity): distinct words that share enough of their trigrams with a query word, itself excepted.

    A stand-in for the similarity of word vectors. Words meet over shared
    trigrams; both sides are vocabularies, not texts.
    """
    def grams(df: DataFrame, name: str) -> DataFrame:
        padded = F.concat(F.lit("^"), F.col(word), F.lit("$"))
        own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))
        rows = df.select(word).where(F.length(word) >= 3).distinct().select(F.col(word).alias(name), own.alias("grams"))
        return rows.select(name, F.size("grams").alias(f"{name}_n"), F.explode("grams").alias("gram"))

    pairs = grams(words, "word").join(grams(asked, "asked"), "gram").groupBy("word", "asked", "word_n", "asked_n").agg(F.count(F.lit(1)).alias("n"))
    similarity = F.round(2 * F.col("n") / (F.col("word_n") + F.col("asked_n")), 4)
    return pairs.where("word <> asked").select("word", "asked", similarity.alias("similarity")).where(F.col("similarity") >= least)
