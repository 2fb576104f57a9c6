"""Registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Rows of matches and raw_scores, those delivered twice once.
HITS = "h AS (SELECT DISTINCT * FROM matches)"
SCORES = "s AS (SELECT DISTINCT * FROM raw_scores)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def sql_tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def sql_padded(tokens: str) -> str:
    return f"(' ' || array_to_string({tokens}, '  ') || ' ')"


def sql_words(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
