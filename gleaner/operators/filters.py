"""Filters: predicates over passages and files. Each is a Column, so that Catalyst pushes it where it can."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T

NEGATION = "not:"
TABLE_BLOCKS = ["table", "table_cell"]


def by_value(column: str, wanted: str | list[str]) -> Column:
    """Equality for one value, membership for a short list."""
    return F.col(column).isin(*wanted) if isinstance(wanted, list) else F.col(column) == wanted


def by_table(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keys``; for lists too long for an expression."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def split_keywords(keywords: list[str]) -> tuple[list[str], list[str]]:
    """Wanted and unwanted keywords; the latter begin with ``not:``."""
    clean = [k.strip() for k in keywords if k and k.strip()]
    unwanted = [k[len(NEGATION) :].strip() for k in clean if k.lower().startswith(NEGATION)]
    return [k for k in clean if not k.lower().startswith(NEGATION)], [k for k in unwanted if k]


def matches_keyword(tokens: Column, padded: Column, keyword: str) -> Column:
    """All words of the keyword; words in quotation marks only as a phrase."""
    plain = keyword.translate(str.maketrans("“”", '""'))
    parts = plain.split('"')
    condition = F.lit(True)
    for i, part in enumerate(parts):
        words = T.split_words(part)
        if words:
            condition = condition & (T.has_phrase(padded, words) if i % 2 else T.has_all(tokens, words))
    return condition


def matches_keywords(tokens: Column, padded: Column, keywords: list[str]) -> Column:
    """Any of the wanted keywords, if there are any, and none of those with ``not:``."""
    wanted, unwanted = split_keywords(keywords)
    match = lambda k: matches_keyword(tokens, padded, k)
    yes = reduce(or_, map(match, wanted)) if wanted else F.lit(True)
    return reduce(and_, (~match(k) for k in unwanted), yes)


def implied_keywords(question: str, keywords: list[str]) -> list[str]:
    """Quoted spans of the question narrow every keyword, or are the keywords if there are none."""
    spans = [f'"{s}"' for s in question.translate(str.maketrans("“”", '""')).split('"')[1::2] if s.strip()]
    if not spans:
        return keywords
    return [" ".join([k, *spans]) for k in keywords] if keywords else [" ".join(spans)]


def phrase_rule(question: str) -> bool:
    """A question that begins with a quotation mark is a phrase search."""
    return question.strip()[:1] in ('"', "“", "'", "‘")


def matches_headers(fields: list[tuple[Column, Column]], headers: list[str]) -> Column:
    """Any wanted header has all its words in one of the fields (tokens, padded), no unwanted one has."""
    wanted, unwanted = split_keywords(headers)
    match = lambda h: reduce(or_, (matches_keyword(t, p, h) for t, p in fields))
    yes = reduce(or_, map(match, wanted)) if wanted else F.lit(True)
    return reduce(and_, (~match(h) for h in unwanted), yes)


def has_entity(entity_types: Column, wanted: list[str]) -> Column:
    """Any of the wanted types is among the blank-separated ones of the passage."""
    return F.coalesce(F.arrays_overlap(F.split(entity_types, r"\s+"), F.array(*(F.lit(w) for w in wanted))), F.lit(False))


def in_pages(page: Column, n_pages: Column, start: Column, end: Column) -> Column:
    """Both ends positive: pages counted from 1; both negative: from the end, -1 the last; otherwise no filter."""
    forward, backward = (start > 0) & (end > 0), (start < 0) & (end < 0)
    reverse = page - n_pages
    unset = (start == -1) & (end == -1)
    return (
        F.when(unset, True)
        .when(forward, F.coalesce(page.between(start - 1, end - 1), F.lit(False)))
        .when(backward, F.coalesce(reverse.between(start, end), F.lit(False)))
        .otherwise(True)
    )


def no_tables(block_type: Column, table_flag: Column | str = "disable") -> Column:
    flag = F.lit(table_flag) if isinstance(table_flag, str) else table_flag
    return ~((F.coalesce(flag, F.lit("")) == "disable") & F.coalesce(block_type.isin(*TABLE_BLOCKS), F.lit(False)))


def no_headers(block_type: Column) -> Column:
    return F.coalesce(block_type != "header", F.lit(True))


def readable(permit: Column, deny: Column, acl: list[str]) -> Column:
    """Nobody in particular reads only what names no readers; others also what permits them and doesn't deny them."""
    if not acl:
        return permit.isNull()
    groups = F.array(*(F.lit(a) for a in acl))
    return (permit.isNull() | F.arrays_overlap(permit, groups)) & ~F.coalesce(F.arrays_overlap(deny, groups), F.lit(False))


def answered(start_probability: Column, answer: Column, text: Column, least: float = 0.3) -> Column:
    """The answer if its probability suffices and it is part of the text, else empty."""
    return F.when((start_probability >= least) & F.coalesce(F.contains(text, answer), F.lit(False)), answer).otherwise("")


def scored(score: Column) -> Column:
    """Hits of score 0 are left out of results."""
    return score != 0
