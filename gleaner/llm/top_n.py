"""Top N items of every group, by a loser-tree merge of sorted runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_ROWS = 500_000


class LoserTree:
    """Merges sorted runs; ``run.key()`` is the head of a run, None at its end.

    Inner nodes hold the losers of the matches below them, the root the winner;
    after the winner moved on, only the matches on its path are played again.
    """

    def __init__(self, keys: list):
        self.n = max(1, len(keys))
        self.keys = list(keys) or [None]
        self.tree = [-1] * self.n
        for leaf in range(self.n):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if y is None:
            return x is not None or a < b
        return x is not None and (x < y or (x == y and a < b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.n) // 2
        while node:
            if self.tree[node] < 0:  # the first to arrive waits here
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def winner(self) -> int:
        return self.tree[0] if self.n > 1 else 0

    def advance(self, key) -> None:
        """The winner's run moved to ``key``."""
        winner = self.winner()
        self.keys[winner] = key
        if self.n > 1:
            node = (winner + self.n) // 2
            while node:
                if self._beats(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def _sorted_run(table: pa.Table, n: int) -> pa.Table:
    """Rows by (group, score descending, item), without copies, at most the first n of a group."""
    groups, items = table.column("grp").combine_chunks().dictionary_encode(), table.column("item").to_numpy()
    names = groups.dictionary
    place = np.empty(len(names), dtype=np.int64)
    place[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
    group, score = place[groups.indices.to_numpy()], table.column("score").to_numpy()
    order = np.lexsort((items, -score, group))
    g, i = group[order], items[order]
    # the same item may come more than once: its best row leads
    by_item = np.lexsort((np.arange(len(order)), i, g))
    first = np.ones(len(order), dtype=bool)
    same = (g[by_item][1:] == g[by_item][:-1]) & (i[by_item][1:] == i[by_item][:-1])
    first[by_item[1:][same]] = False
    order, g = order[first], g[first]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return table.take(pa.array(order[rank < n]))


def _make_runs(n: int, run_rows: int, buckets: int) -> Callable:
    """Sorted runs, each cut into the buckets of its groups: one row for a run's part of a bucket."""

    def pieces(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = _sorted_run(pa.Table.from_batches(held), n).combine_chunks()
        groups = table.column("grp").combine_chunks().dictionary_encode()
        place = groups.indices.to_numpy()
        names = groups.dictionary.to_pylist()
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, dtype=np.int64)
        ends = np.r_[starts[1:], len(place)]
        bucket_of = np.array([crc32(g.encode()) % buckets for g in names], dtype=np.int64)  # the dictionary is in the order of the rows
        items, scores = table.column("item").to_numpy(), table.column("score").to_numpy()
        columns: tuple[list, ...] = ([], [], [], [], [])
        for bucket in np.unique(bucket_of):
            own = np.flatnonzero(bucket_of == bucket)
            sizes = ends[own] - starts[own]
            rows = np.repeat(starts[own] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            for column, value in zip(columns, (int(bucket), [names[g] for g in own], sizes.astype(np.int32), items[rows], scores[rows]), strict=True):
                column.append(value)
        kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "groups", "sizes", "items", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= run_rows:
                yield pieces(held)
                held, rows = [], 0
        if rows:
            yield pieces(held)

    return run


class Run:
    """A sorted run of one bucket: its groups in order, and where each one's rows begin."""

    def __init__(self, groups: pa.Array, sizes: pa.Array, items: pa.Array, scores: pa.Array):
        self.groups = groups
        self.starts = np.r_[0, np.cumsum(sizes.to_numpy())]
        self.items, self.scores = items.to_numpy(), scores.to_numpy()
        self.group = self.at = 0
        self.name = groups[0].as_py() if len(groups) else None

    def key(self) -> tuple | None:
        return None if self.name is None else (self.name, -self.scores[self.at], self.items[self.at])

    def step(self) -> None:
        self.at += 1
        if self.at == self.starts[self.group + 1]:
            self.next_group()

    def next_group(self) -> None:
        self.group += 1
        self.at = self.starts[self.group]
        self.name = self.groups[self.group].as_py() if self.group < len(self.groups) else None


def _merge_runs(n: int, flush_rows: int = 100_000) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [Run(*(batch.column(c)[i].values for c in ("groups", "sizes", "items", "scores"))) for batch in batches for i in range(batch.num_rows)]
        tree = LoserTree([r.key() for r in runs])
        out: tuple[list, list, list, list] = ([], [], [], [])

        def flushed() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.float64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["grp", "item", "score", "rank"])

        group, taken = None, []
        while runs and (head := tree.keys[tree.winner()]) is not None:
            own = runs[tree.winner()]
            if group is None or head[0] != group:
                group, taken = head[0], []
                if len(out[0]) >= flush_rows:
                    yield flushed()
                    out = ([], [], [], [])
            if len(taken) == n:  # seek to the next group
                own.next_group()
            else:
                if head[2] not in taken:
                    taken.append(head[2])
                    for column, value in zip(out, (group, head[2], -head[1], len(taken)), strict=True):
                        column.append(value)
                own.step()
            tree.advance(own.key())
        if out[0]:
            yield flushed()

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """(group, item, score, rank): the ``n`` items of every group with the highest score.

    Of equal scores the lower item comes first. An item delivered more than
    once counts once, with its best score. Null and NaN scores are no scores;
    rows without group or item are no items; a group with fewer scores gives
    fewer rows and an empty table none. ``group`` is a string, ``item`` an
    integer.

    Map tasks sort their rows into runs by (group, score, item) and write at
    most ``n`` rows of a group per run, so a group with any share of all rows
    costs ``n`` rows a run. A run's groups are cut into buckets and stay whole and
    sorted on their way; each bucket merges the runs it gets with a loser tree
    that goes to the next group after ``n`` outputs.
    """
    rows = df.select(
        F.col(group).cast("string").alias("grp"), F.col(item).cast("long").alias("item"), F.col(score).cast("double").alias("score")
    ).where("grp is not null and item is not null and score is not null and not isnan(score)")
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.mapInArrow(_make_runs(n, run_rows, buckets), "bucket int, groups array<string>, sizes array<int>, items array<long>, scores array<double>")
    merged = runs.repartitionById(buckets, "bucket").mapInArrow(_merge_runs(n), "grp string, item long, score double, rank int")
    return merged.select(F.col("grp").alias(group), F.col("item").cast(df.schema[item].dataType).alias(item), F.col("score").alias(score), "rank")
