"""Retrieval scores of passages and files for the queries of a request."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import exp, log
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T

K1, B = 1.2, 0.75
TIE_BREAKER = 0.5
FIELD_WEIGHTS = {"match": 2.0, "header": 1.5, "block": 0.2, "parent": 1.0}


def gram_weight(n: int, base: float = 1.0) -> float:
    """Weight of an n-gram: base, base/e, base/e², rounded."""
    return round(base * exp(1 - n), 2)


@dataclass(frozen=True)
class Gram:
    words: tuple[str, ...]
    weight: float


def query_grams(question: str, base: float = 1.0, stop: list[str] | None = None, most: int = 3) -> list[Gram]:
    """n-grams of the question without stop words that also follow each other in the whole question."""
    every = T.split_words(question)
    dropped = set((stop or T.STOP_WORDS) + T.QUESTION_WORDS + T.BOOL_QUESTION_WORDS)
    content = [w for w in every if w not in dropped]
    whole = T.padded_phrase(every)
    grams = []
    for n in range(1, most + 1):
        for i in range(len(content) - n + 1):
            words = tuple(content[i : i + n])
            if T.padded_phrase(list(words)) in whole and all(g.words != words for g in grams):
                grams.append(Gram(words, gram_weight(n, base)))
    return grams


@dataclass(frozen=True)
class FieldStats:
    """Rows, mean length and, for each word asked for, the rows that hold it."""

    rows: int
    mean_length: float
    holding: dict[str, int]

    def idf(self, word: str) -> float:
        n = self.holding.get(word, 0)
        return log(1 + (self.rows - n + 0.5) / (n + 0.5))


def field_stats(passages: DataFrame, tokens: str, words: list[str]) -> FieldStats:
    """One pass over the passages for all words of a request; one row comes back."""
    holding = [F.count_if(F.array_contains(tokens, w)).alias(f"w{i}") for i, w in enumerate(words)]
    row = passages.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(F.coalesce(tokens, F.array().cast("array<string>")))).alias("mean"), *holding).first()
    return FieldStats(row["n"], row["mean"] or 1.0, {w: row[f"w{i}"] for i, w in enumerate(words)})


def stats_of_fields(passages: DataFrame, fields: dict[str, list[str]]) -> list[FieldStats]:
    """Statistics of several token columns in one pass; one row comes back."""
    columns = [F.count(F.lit(1)).alias("n")]
    for f, (name, words) in enumerate(fields.items()):
        columns.append(F.avg(F.size(F.coalesce(name, F.array().cast("array<string>")))).alias(f"mean{f}"))
        columns += [F.count_if(F.array_contains(name, w)).alias(f"w{f}_{i}") for i, w in enumerate(words)]
    row = passages.agg(*columns).first()
    return [FieldStats(row["n"], row[f"mean{f}"] or 1.0, {w: row[f"w{f}_{i}"] for i, w in enumerate(words)}) for f, words in enumerate(fields.values())]


def saturation(frequency: Column, length: Column, mean_length: float) -> Column:
    return frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * length / mean_length))


def phrase_score(padded: Column, length: Column, words: tuple[str, ...], stats: FieldStats) -> Column:
    """BM25 of a phrase: the weight of all its words, the frequency of the whole."""
    found = T.phrase_count(padded, list(words))
    score = sum(stats.idf(w) for w in words) * saturation(found, length, stats.mean_length)
    return F.when(found > 0, score).otherwise(F.lit(0.0))


def total(scores: list[Column]) -> Column:
    return reduce(add, scores) if scores else F.lit(0.0)


def ngram_score(padded: Column, length: Column, grams: list[Gram], stats: FieldStats) -> Column:
    """Sum over the query's n-grams of weight times BM25."""
    return total([g.weight * phrase_score(padded, length, g.words, stats) for g in grams])


def explained(padded: Column, length: Column, grams: list[Gram], stats: FieldStats) -> Column:
    """The n-grams that a score comes from, as (term, weight), the heaviest first; repeated words are told once, by the longest n-gram they have."""
    parts = [F.struct(F.round(g.weight * phrase_score(padded, length, g.words, stats), 4).alias("weight"), F.lit(" ".join(g.words)).alias("term")) for g in grams]
    if not parts:
        return F.array().cast("array<struct<term:string,weight:double>>")
    hit = F.filter(F.array(*parts), lambda p: p["weight"] > 0)
    padded_term = lambda p: F.concat(F.lit(" "), p["term"], F.lit(" "))
    inside = lambda p: F.exists(hit, lambda o: (F.length(o["term"]) > F.length(p["term"])) & F.contains(padded_term(o), padded_term(p)))
    order = F.transform(F.filter(hit, lambda p: ~inside(p)), lambda p: F.struct((-p["weight"]).alias("w"), p["term"].alias("t")))
    return F.transform(F.array_sort(order), lambda p: F.struct(p["t"].alias("term"), (-p["w"]).alias("weight")))


def unit_ngram_score(padded: Column, grams: list[Gram]) -> Column:
    """The same with a score of one for every n-gram that occurs."""
    return total([F.when(T.has_phrase(padded, list(g.words)), g.weight).otherwise(0.0) for g in grams])


def best_of(clauses: list[Column], tie_breaker: float = TIE_BREAKER) -> Column:
    """Largest clause plus a part of the others; null if none matches (is above 0)."""
    values = [F.coalesce(c, F.lit(0.0)) for c in clauses]
    top = values[0] if len(values) == 1 else F.greatest(*values)
    return F.when(top > 0, top + tie_breaker * (total(values) - top))


def cross_fields(fields: dict[str, tuple[Column, Column, FieldStats]], words: list[str], weights: dict[str, float]) -> Column:
    """For every word the best weighted field, summed; a field is (padded, length, statistics)."""
    per_word = []
    for word in words:
        scores = [weights[name] * phrase_score(p, n, (word,), stats) for name, (p, n, stats) in fields.items()]
        per_word.append(scores[0] if len(scores) == 1 else F.greatest(*scores))
    return total(per_word)


def header_boost(fields: list[tuple[Column, Column, FieldStats]], headers: list[str]) -> Column:
    """The best header by its best field."""
    scores = [ngram_score(p, n, query_grams(h), s) for h in headers for p, n, s in fields]
    return F.lit(0.0) if not scores else scores[0] if len(scores) == 1 else F.greatest(*scores)


def normalised(score: Column, best: Column) -> Column:
    """Score over the file's best one, which counts as 1 at least; never over 1."""
    return F.least(F.lit(1.0), score / F.greatest(F.lit(1.0), best))


def relevancy(text: Column, templates: Column, is_table: Column, base: float = 0.7, table_base: float = 0.1) -> Column:
    """base + (1 - base) times the largest share of a template's stems that the text has."""
    start = F.when(is_table, table_base).otherwise(base)
    own = T.stems(text)

    def share(template: Column) -> Column:
        wanted = T.stems(template)
        return F.when(F.size(wanted) > 0, F.size(F.array_intersect(own, wanted)) / F.size(wanted)).otherwise(0.0)

    best = F.coalesce(F.array_max(F.transform(templates, share)), F.lit(0.0))
    return start + (1 - start) * best


def entity_clause(entity_types: Column, wanted: list[str], weight: float = 2.0) -> Column:
    """Weight for every wanted type among the blank-separated types of a passage."""
    held = F.split(F.coalesce(entity_types, F.lit("")), r"\s+")
    return total([F.when(F.array_contains(held, w), weight).otherwise(0.0) for w in wanted])


def key_value_boost(padded: Column, length: Column, texts: list[str], stats: FieldStats) -> Column:
    """Phrase score over a passage's key-value field, with weights of twice those of the text."""
    grams = {g.words: g for t in texts for g in query_grams(t, 2.0)}
    return ngram_score(padded, length, list(grams.values()), stats)


def quoted_boost(padded: Column, phrases: list[str], stats: FieldStats, length: Column, weight: float = 2.0) -> Column:
    """Weighted score of whole quoted phrases."""
    return total([weight * phrase_score(padded, length, tuple(T.split_words(p)), stats) for p in phrases if T.split_words(p)])


def boosted(score: Column, boosters: list[Column]) -> Column:
    """A matching score plus its boosters; without match there is no score."""
    return F.when(score.isNotNull(), score + total([F.coalesce(b, F.lit(0.0)) for b in boosters]))


def use_dynamic_boosters(is_question: bool, enabled_for_questions: bool = False) -> bool:
    return enabled_for_questions or not is_question


def table_scores(index_scores: DataFrame) -> DataFrame:
    """(table_id, score): the best column of each table by the sum of its entries' scores (table_id, column, score)."""
    columns = index_scores.groupBy("table_id", "column").agg(F.sum("score").alias("score"))
    return columns.groupBy("table_id").agg(F.max("score").alias("score"))


def page_info(total_hits: int, offset: int, size: int) -> dict[str, int]:
    """Pagination of a result; a page beyond the end is empty."""
    shown = max(0, min(size, total_hits - offset))
    return {"total": total_hits, "offset": offset, "size": size, "shown": shown}


def with_fallback(narrow: DataFrame, wide: DataFrame) -> DataFrame:
    """The narrow result if it has a row, else the wide one: for filters that are dropped where they leave nothing."""
    return wide if narrow.isEmpty() else narrow
