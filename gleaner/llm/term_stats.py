"""Frequency of every distinct term, by last-seen counters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"\p{L}+")
QUOTES = "\"'“”‘’„‚"
FLUSH_TERMS = 200_000


def words_of(text: str) -> list[str]:
    """Longest runs of letters, in lower case."""
    return WORD.findall(text.lower())


def keyword_of(raw: str) -> str:
    """A keyword in lower case and NFC, single-spaced, without ``not:`` in front and enclosing quotation marks."""
    term = " ".join(unicodedata.normalize("NFC", raw).lower().split())
    while True:
        bare = term.removeprefix("not:").strip()
        if len(bare) > 1 and bare[0] in QUOTES and bare[-1] in QUOTES:
            bare = bare[1:-1].strip()
        if bare == term:
            return unicodedata.normalize("NFC", term)
        term = bare


def keywords_of(raw: list[str | None]) -> list[str]:
    return [t for t in (keyword_of(k) for k in raw if k is not None) if t and t not in QUOTES]


def _counters(terms_of: Callable, flush: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(state.keys(), pa.string()), pa.array((s[0] for s in state.values()), pa.int64()), pa.array((s[1] for s in state.values()), pa.int64())],
                names=["term", "occurrences", "records"],
            )

        serial = 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                serial += 1  # each row of the grouped input is one whole record
                for term in terms_of(value):
                    seen = state.get(term)
                    if seen is None:
                        state[term] = [1, 1, serial]
                    else:
                        seen[0] += 1
                        if seen[2] != serial:
                            seen[1] += 1
                            seen[2] = serial
            if len(state) > flush:
                yield out()
                state.clear()
        yield out()

    return run


def term_frequencies(df: DataFrame, record: str, value: str, kind: str, flush: int = FLUSH_TERMS) -> DataFrame:
    """(term, occurrences, records) over all records of ``df``.

    ``kind`` is 'words' (``value`` is text) or 'keywords' (an array of
    strings). Rows with the same ``record`` are one record and count once,
    however often they were delivered; the smallest value counts if they
    differ. Rows whose record is null are no records. Null values, null or blank keywords and
    texts without letters give no terms; an empty table gives no rows. Each
    record lies in one partition, in record order, and each term of a
    partition holds its occurrences, its records and the last record seen, so
    no set of records exists. A partition hands on its counters whenever it
    holds over ``flush`` terms, between two batches of records.
    """
    kept = df.select(F.col(record).alias("record"), F.col(value).alias("value")).where("record is not null")
    whole = kept.groupBy("record").agg(F.min("value").alias("value")).where("value is not null").select("value")
    partial = whole.mapInArrow(
        _counters(words_of if kind == "words" else keywords_of, flush), "term string, occurrences long, records long"
    )
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(
    df: DataFrame, record: str, value: str, kind: str, field: str, rare_records: int = 2, common_per_cent: int = 5
) -> DataFrame:
    """(field, term, occurrences, records, mark): ``term_frequencies`` with 'rare', 'common' or null.

    Rare: in at most ``rare_records`` records (this wins). Common: in at least
    ``common_per_cent`` of all records of the table, those without value included.
    """
    total = df.agg(F.count_distinct(F.col(record))).scalar()
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") * 100 >= total * common_per_cent, "common")
    terms = term_frequencies(df, record, value, kind)
    return terms.select(F.lit(field).alias("field"), "term", "occurrences", "records", mark.alias("mark"))
