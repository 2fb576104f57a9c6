"""One ranking from several differently-scaled scores: robust rank aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import comb
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators.ordered import average_ranks
from gleaner.session import written

HOT_ROWS = 200_000
FLUSH_ROWS = 200_000


def beta_tail(r: np.ndarray, k: int, m: int) -> np.ndarray:
    """P(k-th smallest of m uniform values <= r) = P(Beta(k, m - k + 1) <= r).

    Powers are products from the left, so that equal ranks give equal bits anywhere.
    """

    def power(x: np.ndarray, n: int) -> np.ndarray:
        return reduce(mul, [x] * n, 1.0)

    return sum(comb(m, j) * power(r, j) * power(1 - r, m - j) for j in range(k, m + 1))


def significance_of_firsts(size: Column, firsts: int, m: int) -> Column:
    """The largest ``rho`` of an item of ``size`` that leads ``firsts`` of ``m`` scores."""
    r = 1 / size
    tail = sum(comb(m, j) * F.pow(r, F.lit(j)) * F.pow(1 - r, F.lit(m - j)) for j in range(firsts, m + 1))
    return F.least(F.lit(1.0), m * tail) * (1 + 1e-9)


def significance(normalised: np.ndarray) -> np.ndarray:
    """Corrected minimum over the order statistics of each row of normalised ranks (1 where missing)."""
    m = normalised.shape[1]
    ordered = np.sort(normalised, axis=1)
    return np.minimum(1.0, m * np.min([beta_tail(ordered[:, k - 1], k, m) for k in range(1, m + 1)], axis=0))


def _average_ranks(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Average rank of each value in its group, highest first; NaN where the value is NaN."""
    ranks = np.full(len(value), np.nan)
    there = np.flatnonzero(~np.isnan(value))
    if not len(there):
        return ranks
    order = there[np.lexsort((-value[there], group[there]))]
    g, v = group[order], value[order]
    new_group = np.r_[True, g[1:] != g[:-1]]
    new_value = new_group | np.r_[True, v[1:] != v[:-1]]
    first = np.flatnonzero(new_value)
    last = np.r_[first[1:], len(g)] - 1
    start = np.maximum.accumulate(np.where(new_group, np.arange(len(g)), 0))
    tie = np.cumsum(new_value) - 1
    ranks[order] = (first[tie] + last[tie]) / 2 - start + 1
    return ranks


def _fuse(m: int, keys: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come by group; whole groups are ranked as soon as enough rows are there."""
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= FLUSH_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                group = table.column("grp").combine_chunks()
                last = pc.index(pc.equal(group, group[-1]), True).as_py()
                if last:
                    yield from ranked(table.slice(0, last).combine_chunks())
                held = table.slice(last).to_batches()
                rows = len(table) - last
        if rows:
            yield from ranked(pa.Table.from_batches(held).combine_chunks())

    def ranked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = [f"rank_{i}" for i in range(m)]
        code = table.column("grp").combine_chunks().dictionary_encode()
        group = code.indices.to_numpy()
        size = np.bincount(group)[group]
        ranks = np.stack([_average_ranks(group, table.column(f"s{i}").to_numpy().astype(float)) for i in range(m)], axis=1)
        rho = significance(np.where(np.isnan(ranks), 1.0, ranks / size[:, None]))
        tie = [table.column(f"k{i}").combine_chunks() for i in reversed(range(keys))]
        tie = [t.dictionary_encode() if pa.types.is_string(t.type) else t for t in tie]
        columns = []
        for t in tie:
            if isinstance(t, pa.DictionaryArray):
                place = np.empty(len(t.dictionary), dtype=np.int64)
                place[pc.array_sort_indices(t.dictionary).to_numpy()] = np.arange(len(t.dictionary))
                columns.append(place[t.indices.to_numpy()])
            else:
                columns.append(t.to_numpy())
        order = np.lexsort((*columns, rho, group))
        g = group[order]
        start = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0))
        position = np.empty(len(g), dtype=np.int64)
        position[order] = np.arange(len(g)) - start + 1
        kept = ["grp", *(f"k{i}" for i in range(keys))]
        yield from pa.Table.from_arrays(
            [*(table.column(c) for c in kept), pa.array(size.astype(np.int64)), *(pa.array(ranks[:, i], from_pandas=True) for i in range(m)), pa.array(rho), pa.array(position)],
            names=[*kept, "n_items", *names, "rho", "position"],
        ).to_batches(max_chunksize=100_000)

    return run


def fuse_rankings(
    df: DataFrame, group: str, keys: list[str], scores: dict[str, Column], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(group, keys, n_items, <score>_rank..., rho, position): one ranking of every group's items.

    ``keys`` identify an item of a group (strings or integers); items delivered
    more than once count once. Each score gives average ranks, 1 = highest
    value, divided by the number of items of the group; null and NaN scores
    have no rank and the normalised rank 1. ``rho`` is the Bonferroni-corrected
    minimum of the beta probabilities of an item's sorted ranks, ``position``
    its place by (rho, keys). Only ranks count, so no score decides because of
    its range. Rows without group or key are no items; an empty table gives no rows.

    Groups up to ``hot_rows`` rows are ranked in one pass over one shuffle, a
    task holding about one group at a time. Larger ones, however many, are
    ranked over range partitions, with the same result.
    """
    m, n_keys = len(scores), len(keys)
    named = {f"k{i}": (F.col(k) if dict(df.dtypes)[k] == "string" else F.col(k).cast("long")) for i, k in enumerate(keys)}
    values = {f"s{i}": F.when(~F.isnan(s), s) for i, s in enumerate(c.cast("double") for c in scores.values())}
    rows = df.select(F.col(group).alias("grp"), *(c.alias(n) for n, c in named.items()), *(c.alias(n) for n, c in values.items()))
    rows = rows.where(" and ".join(f"{c} is not null" for c in ("grp", *named)))
    kinds = dict(rows.dtypes)
    hot = written(rows.groupBy("grp").count().where(F.col("count") > hot_rows).select("grp"))  # one row for each hot_rows rows at most
    schema = ", ".join(
        [*(f"{c} {kinds[c]}" for c in ("grp", *named)), "n_items long", *(f"rank_{i} double" for i in range(m)), "rho double", "position long"]
    )
    once = lambda d: d.groupBy("grp", *named).agg(*(F.max(c).alias(c) for c in values))
    some = not hot.isEmpty()
    small = rows.join(hot, "grp", "left_anti") if some else rows
    # one shuffle: rows of a group are together, so are those of an item
    fused = once(small.repartition("grp")).sortWithinPartitions("grp").mapInArrow(_fuse(m, n_keys), schema)
    if some:
        fused = fused.unionByName(_fuse_hot(once(rows.join(hot, "grp", "left_semi")), [*named], m))
    return fused.select(
        F.col("grp").alias(group),
        *(F.col(f"k{i}").cast(df.schema[k].dataType).alias(k) for i, k in enumerate(keys)),
        "n_items",
        *(F.col(f"rank_{i}").alias(f"{s}_rank") for i, s in enumerate(scores)),
        "rho",
        "position",
    )


def _fuse_hot(items: DataFrame, keys: list[str], m: int) -> DataFrame:
    items = written(items)
    sizes = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n_items"))
    ranked = items.join(sizes, "grp")
    for i in range(m):
        ranks = average_ranks(items, ["grp"], f"s{i}", f"rank_{i}")
        ranked = ranked.join(ranks, ["grp", f"s{i}"], "left")

    def rho_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks = np.stack([b.column(f"rank_{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(m)], axis=1)
            size = b.column("n_items").to_numpy()
            rho = significance(np.where(np.isnan(ranks), 1.0, ranks / size[:, None]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rho)], names=[*b.schema.names, "rho"])

    ranked = ranked.select("grp", *keys, "n_items", *(f"rank_{i}" for i in range(m)))
    schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes) + ", rho double"
    with_rho = written(ranked.mapInArrow(rho_of, schema))
    return with_rho.join(_positions(with_rho.select("grp", *keys, "rho"), keys), ["grp", *keys]).select(
        "grp", *keys, "n_items", *(f"rank_{i}" for i in range(m)), "rho", "position"
    )


def _positions(order: DataFrame, keys: list[str]) -> DataFrame:
    """Places by rho, then keys, over range partitions."""
    n = int(order.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(order.repartitionByRange(n, "grp", "rho", *keys).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("grp", "__part").agg(F.count(F.lit(1)).alias("__total"))
    before = W.partitionBy("grp").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("grp", "__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy("grp", "__part").orderBy("rho", *keys)
    return ranged.join(offsets, ["grp", "__part"]).select(
        "grp", *keys, (F.col("__offset") + F.row_number().over(inside)).alias("position")
    )
