"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("gleaner", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(vocabulary) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            if encode is None:
                encode = encoder(vocabulary.value).encode_ordinary
            sizes = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"]
            )

    return run


def token_counts(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(keep..., n_tokens): the size of each whole ``text``; 0 for null and empty ones.

    The vocabulary file is read on the driver and broadcast (under 2 MB), so
    executors need no copy.
    """
    content = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rows = df.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:-1]), "n_tokens long"])
    return rows.mapInArrow(_count(content), schema)
