"""Share of repeated words inside each document.

A count of equal lines across documents says nothing about repetition within
one text, so the operator compares each text's own word windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"\p{L}+")
CHUNK_WORDS = 2_000_000


def repeated_mask(ids: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that equals a window with an earlier start in the same document.

    Windows are ranked exactly by doubling: the rank of 2k words is the rank
    of the pair (rank of k words, rank of the next k words); no hash is involved.
    """
    n = len(ids)
    marked = np.zeros(n, dtype=bool)
    if n < window:
        return marked
    ranks, span = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while span < window:
        step = min(span, window - span)
        m = len(ranks) - step
        if m <= 0:
            return marked
        width = int(ranks.max()) + 1
        ranks = np.unique(ranks[:m] * width + ranks[step : step + m], return_inverse=True)[1].astype(np.int64)
        span += step
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    code = ranks[starts] * (int(doc.max()) + 1) + doc[starts]
    order = np.argsort(code, kind="stable")
    again = np.zeros(len(starts), dtype=bool)
    again[order[1:]] = code[order][1:] == code[order][:-1]
    edge = np.zeros(n + 1, dtype=np.int64)
    hit = starts[again]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _measure(window: int, chunk_words: int) -> Callable:
    def flush(held: list) -> pa.RecordBatch:
        number: dict[str, int] = {}
        flat = [number.setdefault(w, len(number)) for _, words in held for w in words]
        sizes = np.array([len(words) for _, words in held], dtype=np.int64)
        doc = np.repeat(np.arange(len(held)), sizes)
        marked = repeated_mask(np.array(flat, dtype=np.int64), doc, window) if flat else np.zeros(0, dtype=bool)
        repeated = np.bincount(doc[marked], minlength=len(held)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in held], pa.int64()), pa.array(sizes), pa.array(repeated)], names=["doc", "n_words", "n_repeated"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((key, WORD.findall((text.as_py() or "").lower())))
                size += len(held[-1][1])
                if size >= chunk_words:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def repetition(df: DataFrame, doc: str, text: str, window: int = 8, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc, n_words, n_repeated, share): how much of each text repeats earlier words of it.

    A word is repeated if it lies in a stretch of at least ``window`` words
    that also begins at an earlier word of the same text; the two may overlap.
    Words are runs of letters in lower case. Null, empty and wordless texts
    have share 0. Rows without ``doc`` are left out; a ``doc`` on several rows
    gives one row for each. No shuffle: every text is measured where it is read.
    """
    rows = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null")
    measured = rows.mapInArrow(_measure(window, chunk_words), "doc long, n_words long, n_repeated long")
    share = F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0))
    return measured.select(F.col("doc").cast(df.schema[doc].dataType).alias(doc), "n_words", "n_repeated", share.alias("share"))
