"""Filling fixed-capacity containers: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordered import running_sum_by_hash

SEED = 7


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Packing patterns for ``histogram`` (length -> items), and the number of packs.

    Lengths are placed longest first, each into the packs that are shortest so
    far, or into new packs if it fits into none. Equal packs are handled
    together as an interval of pack numbers, so the work depends on the number
    of lengths, not of items. Rows (length, first rank, items, first pack): the
    items of that length with these ranks go to consecutive packs. Their number
    is bounded by the capacity alone: a row ends a length or fills an interval up.
    """
    open_packs: list[tuple[int, int, int]] = []  # total length, first pack, packs
    rows, n_packs = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if open_packs and open_packs[0][0] + length <= capacity:
                total, first, packs = heapq.heappop(open_packs)
                used = min(packs, left)
                if packs > used:
                    heapq.heappush(open_packs, (total, first + used, packs - used))
            else:  # one by one, each new pack is the shortest until it is full
                stack = min(capacity // length, left)
                total, first, used = (stack - 1) * length, n_packs, left // stack
                n_packs += used
                for _ in range(stack - 1):
                    rows.append((length, rank, used, first))
                    left -= used
                    rank += used
            rows.append((length, rank, used, first))
            if total + length < capacity:
                heapq.heappush(open_packs, (total + length, first, used))
            left -= used
            rank += used
    return np.array(rows, dtype=np.int64).reshape(-1, 4), n_packs


def _assign(patterns: np.ndarray) -> Callable:
    order = np.lexsort((patterns[:, 1], patterns[:, 0]))
    length, rank, _, pack = patterns[order].T.copy()
    width = np.int64(2**40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = length * width + rank
        for batch in batches:
            own_length, own_rank = batch.column("n_tokens").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(code, own_length * width + own_rank, side="right") - 1
            container = pack[at] + own_rank - rank[at]
            columns = [batch.column(c) for c in ("doc", "piece", "first_token", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(container)], names=["doc", "piece", "first_token", "n_tokens", "container"])

    return run


def pack(sizes: DataFrame, doc: str, size: str, capacity: int) -> DataFrame:
    """(doc, piece, first_token, n_tokens, container): every text of ``sizes`` in containers of ``capacity``.

    A text is split only if it alone exceeds the capacity: into full pieces,
    each filling a container, and a rest, which is packed like a text. Texts
    without tokens need no space: one row with container null. Null sizes count
    as 0, rows without ``doc`` are left out, and several rows of one ``doc``
    are several texts. An empty table gives no rows. Containers are numbered from 0.

    Only the histogram of lengths, at most ``capacity`` rows, reaches the
    driver, and only the patterns, bounded by the capacity, go back. Ranks
    within a length are taken over hashed buckets, so a length shared by any
    part of the texts is spread.
    """
    texts = sizes.select(F.col(doc).alias("doc"), F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0).cast("long")).alias("size"))
    texts = texts.where("doc is not null")
    full, rest = F.floor(F.col("size") / capacity), F.col("size") % capacity
    histogram = {r[0]: r[1] for r in texts.select(rest.alias("rest")).where("rest > 0").groupBy("rest").count().collect()}
    patterns, n_packs = shortest_pack_first(histogram, capacity)
    kind = dict(texts.dtypes)["doc"]

    rests = texts.where(rest > 0).select(
        "doc", full.cast("int").alias("piece"), (full * capacity).alias("first_token"), rest.alias("n_tokens"), F.lit(1).alias("__one"),
        F.xxhash64(F.lit(SEED), "doc").alias("__key"),
    )
    ranked = running_sum_by_hash(rests, ["n_tokens"], "__key", ["doc"], "__one", "rank")
    packed = ranked.select("doc", "piece", "first_token", "n_tokens", F.col("rank").cast("long").alias("rank"))
    schema = f"doc {kind}, piece int, first_token long, n_tokens long, container long"
    packed = packed.mapInArrow(_assign(patterns), schema) if len(patterns) else packed.withColumnRenamed("rank", "container")

    long_texts = texts.where(full > 0).select("doc", full.alias("__full"), F.lit(0).alias("__all"), F.xxhash64(F.lit(SEED), "doc").alias("__key"))
    placed = running_sum_by_hash(long_texts, ["__all"], "__key", ["doc"], "__full", "__start")
    pieces = placed.select("doc", "__start", F.explode(F.sequence(F.lit(0), F.col("__full").cast("int") - 1)).alias("piece")).select(
        "doc", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"),
        (F.col("__start") + F.col("piece") + n_packs).cast("long").alias("container"),
    )
    empty = texts.where("size = 0").selectExpr("doc", "0 AS piece", "0L AS first_token", "0L AS n_tokens", "CAST(NULL AS LONG) AS container")
    return packed.unionByName(pieces).unionByName(empty).withColumnRenamed("doc", doc)
