"""Pairs of similar word sets: blocked by combinations of rare words, exactly verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import written

#: A word is counted if more than 1/COMMON_PARTS of the sets hold it, so the counts sent to all tasks are bounded.
COMMON_PARTS = 2_000
#: A combination of words is a block key once so few sets are expected to hold it.
BLOCK_SETS = 32
MAX_WORDS = 6
FLUSH_KEYS = 1_000_000
#: A task compares the sets of about so many keys.
BUCKET_KEYS = 500_000
KEYS_OF_A_SET = 24
LONG_RUN = 2_000
#: So many sets that differ in one word are a class, whose pairs aren't made.
CLASS_SETS = 64
#: Larger sets travel with this size.
LARGEST = 65_535
MIX = 0x9E3779B97F4A7C15
MASK = 2**64 - 1


def words_column(text: Column) -> Column:
    """Distinct words (runs of letters, lower case) of a text as sorted 64-bit hashes."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)))
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))


def block_keys(shares: list[float], words: list[int], needed: int, sets: int, block: int, most: int = MAX_WORDS) -> list[int]:
    """Block keys of one set, whose ``words`` are ordered from the rarest on.

    Two sets that must have ``needed`` words in common share their first,
    second, ... common word within the first len - needed + 1, + 2, ... words
    of both. So the path along their common words appears in both sets'
    combinations, cut where the words' ``shares`` let ``block`` sets be
    expected; the cut depends on the path alone.
    """
    keys, spare, n = [], len(words) - needed, len(words)

    def walk(start: int, level: int, path: int, expected: float) -> None:
        for i in range(start, min(n, spare + level)):
            left = expected * shares[i]
            key = (path * MIX + words[i]) & MASK
            if left <= block or level == most or level == needed:
                keys.append(key)
            else:
                walk(i + 1, level + 1, key, left)

    walk(0, 1, 0, float(sets))
    return keys


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], names=["word", "n"])


def _mixed(words: np.ndarray, seed: int) -> np.ndarray:
    x = (words.astype(np.uint64) + np.uint64(seed)) * np.uint64(MIX)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _signatures(common: np.ndarray, least: int) -> Callable:
    """Of every set of ``least`` words or more and each of its words not among the ``common``: 128 bits that stand for the set without the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            words = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rare = (sizes[owner] >= least) & ~np.isin(words, common)
            without = []
            for seed in (1, 2):
                mixed = _mixed(words, seed)
                without.append((np.add.reduceat(mixed, starts)[owner] - mixed)[rare].view(np.int64))
            owner = owner[rare]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[owner]), pa.array(sizes[owner].astype(np.int32)), *map(pa.array, without)], names=["row", "size", "s1", "s2"])

    return run


def one_word_classes(sets: DataFrame, common: dict[int, int], threshold: float) -> DataFrame | None:
    """(row, class, size): sets of ``size`` words that are equal but for one rare word, ``CLASS_SETS`` of them at least; None if there are none.

    A word is rare if it is not counted in ``common`` or in ``CLASS_SETS`` sets at most.
    Two of a class have size - 1 words in common of size + 1, so all are similar
    to each other, and no pairs of them need be made. A set of several
    classes is counted to the largest.
    """
    least = ceil((1 + threshold) / (1 - threshold) - 1e-9) if threshold < 1 else 2**31 - 1
    known = np.array(sorted(w for w, n in common.items() if n > CLASS_SETS), dtype=np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(known)  # bounded like the counts

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _signatures(shared.value, least)(batches)

    each = sets.select("row", "words").mapInArrow(signatures, "row long, size int, s1 long, s2 long")
    large = written(each.groupBy("s1", "s2", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CLASS_SETS))
    if large.isEmpty():
        return None
    own = each.join(large, ["s1", "s2", "size"]).groupBy("row").agg(F.max(F.struct("n", "s1", "s2", "size")).alias("c"))
    return written(own.select("row", F.xxhash64("c.s1", "c.s2", "c.size").alias("class"), F.col("c.size").alias("size")))


def _scatter(counts: dict[int, int], sets: int, threshold: float, block: int, buckets: int) -> Callable:
    def flush(keys: list, rows: list, maps: list, sizes: list, classes: list) -> pa.RecordBatch:
        key = np.array(keys, dtype=np.uint64)
        repeat = np.array([s[1] for s in sizes])
        row = np.repeat(np.array(rows, dtype=np.int64), repeat)
        bits = np.repeat(np.array(maps, dtype=np.uint64), repeat)
        size = np.repeat(np.minimum([s[0] for s in sizes], LARGEST).astype(np.uint16), repeat)
        group = np.repeat(np.array(classes, dtype=np.int64), repeat)
        bucket, high = (key % np.uint64(buckets)).astype(np.int64), row >> 16
        order = np.lexsort((high, bucket))
        key, row, bits, size, bucket, high, group = (x[order] for x in (key, row, bits, size, bucket, high, group))
        start = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (high[1:] != high[:-1])])
        cuts = list(zip(start, np.r_[start[1:], len(key)], strict=True))
        low = (row & 0xFFFF).astype(np.uint16)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[start]), pa.array(high[start]), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (key, low, bits, size)),
                pa.array([group[a:b].tobytes() if group[a:b].any() else b"" for a, b in cuts], pa.binary()),
            ],
            names=["bucket", "high", "keys", "lows", "maps", "sizes", "classes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, maps, sizes, classes = [], [], [], [], []
        rare = 1 / COMMON_PARTS
        for batch in batches:
            for row, words, group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ordered = sorted((counts.get(w, 0), w) for w in words)
                shares = [c / sets if c else rare for c, _ in ordered]
                own = block_keys(shares, [w for _, w in ordered], ceil(threshold * len(words) - 1e-9), sets, block)
                bits = 0
                for w in words:
                    bits |= 1 << (w & 63)
                keys += own
                rows.append(row)
                maps.append(bits)
                sizes.append((len(words), len(own)))
                classes.append(group or 0)
            if len(keys) >= FLUSH_KEYS:
                yield flush(keys, rows, maps, sizes, classes)
                keys, rows, maps, sizes, classes = [], [], [], [], []
        if keys:
            yield flush(keys, rows, maps, sizes, classes)

    return run


def _possible(bits_a: np.ndarray, bits_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sizes and bit maps of two sets allow the threshold."""
    keep = np.bitwise_count(bits_a ^ bits_b) <= (size_a + size_b) * (1 - threshold) / (1 + threshold) + 1e-9
    keep &= np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b) - 1e-9
    return keep | (np.maximum(size_a, size_b) == LARGEST)  # such a size is not known


def _pairs_across(own: np.ndarray, other: np.ndarray, row: np.ndarray, bits: np.ndarray, size: np.ndarray, threshold: float) -> list[np.ndarray]:
    found = []
    for i in range(0, len(own), 1_024):
        for j in range(0, len(other), 4_096):
            a, b = own[i : i + 1_024], other[j : j + 4_096]
            x, y = np.nonzero(_possible(bits[a][:, None], bits[b][None, :], size[a][:, None], size[b][None, :], threshold))
            if len(x):
                p, q = row[a[x]], row[b[y]]
                found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1))
    return found


def _pairs_of_runs(
    key: np.ndarray, row: np.ndarray, bits: np.ndarray, size: np.ndarray, threshold: float, group: np.ndarray | None = None, split: bool = True
) -> list[np.ndarray]:
    """Pairs with equal keys, but not of one class, that the sizes and bit maps don't rule out."""
    group = np.zeros(len(key), dtype=np.int64) if group is None else group
    order = np.argsort(key, kind="stable")
    key, row, bits, size, group = key[order], row[order], bits[order], size[order].astype(np.int64), group[order]
    new = np.r_[True, key[1:] != key[:-1]]
    start = np.flatnonzero(new)
    length = np.diff(np.r_[start, len(key)])
    found = []
    if split:
        # a long run is cut by parts of the bit map: maps that differ in at most m bits agree in one of m + 1 parts
        for s, n in zip(start[length > LONG_RUN], length[length > LONG_RUN], strict=True):
            r, b, z, g = row[s : s + n], bits[s : s + n], size[s : s + n], group[s : s + n]
            left = np.ones(n, dtype=bool)
            classes, members = np.unique(g[g != 0], return_counts=True)
            for one in classes[members > LONG_RUN // 10]:  # a large class is only compared with what is behind it
                left &= g != one
                found += _pairs_across(np.flatnonzero(g == one), np.flatnonzero(left), r, b, z, threshold)
            r, b, z, g = r[left], b[left], z[left], g[left]
            if not len(r):
                continue
            most = int(2 * z.max() * (1 - threshold) / (1 + threshold))
            parts = min(most + 1, 64)
            edges = np.linspace(0, 64, parts + 1).astype(int)
            if most < 64:
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    part = (b >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)
                    found += _pairs_of_runs(part, r, b, z, threshold, g, split=False)
            else:
                found += _pairs_of_runs(np.zeros(len(r), np.uint64), r, b, z, threshold, g, split=False)
    end = np.repeat(start + length, length)
    at = np.flatnonzero(np.repeat((length > 1) & ((length <= LONG_RUN) | (not split)), length))
    d = 1
    while len(at := at[at + d < end[at]]):
        a, b = at, at + d
        keep = _possible(bits[a], bits[b], size[a], size[b], threshold) & ((group[a] == 0) | (group[a] != group[b]))
        a, b = row[a[keep]], row[b[keep]]
        if len(a):
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        d += 1
    return found


def _gather(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, high, keys, lows, maps, sizes, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(bucket, []).append((high, keys, lows, maps, sizes, classes or bytes(len(keys))))
        for bucket in list(held):
            parts = held.pop(bucket)
            key, bits = (np.concatenate([np.frombuffer(p[i], np.uint64) for p in parts]) for i in (1, 3))
            row = np.concatenate([(p[0] << 16) + np.frombuffer(p[2], np.uint16).astype(np.int64) for p in parts])
            size = np.concatenate([np.frombuffer(p[4], np.uint16) for p in parts])
            group = np.concatenate([np.frombuffer(p[5], np.int64) for p in parts])
            if pairs := _pairs_of_runs(key, row, bits, size, threshold, group):
                pairs = np.unique(np.concatenate(pairs), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["x", "y"])

    return run


def similar_sets(df: DataFrame, id: str, text: str, threshold: float = 0.75, least_words: int = 8) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(members, links, classes): texts whose distinct words overlap by at least ``threshold`` (common words / words of either).

    members: (id, rep), every record with at least ``least_words`` distinct
    words and the smallest id with the same set of words. links: (a, b,
    distance) between representatives, a < b, each pair once, all pairs found but
    those of two representatives of one class. classes: (id, class, distance),
    representatives that differ in one word; all of a class have this distance
    from each other. None if there are no classes.
    Records without id or text have no row. Rows delivered twice count once.

    Equal sets are collapsed first, however many there are. The rest meet only
    in blocks of shared rare-word combinations; a pair leaves its block as two
    row numbers if set sizes and 64-bit maps of the words allow the threshold,
    and is verified on the whole sets.
    """
    words = df.select(F.col(id).cast("long").alias("id"), words_column(F.col(text)).alias("words")).where(F.col("id").isNotNull() & (F.size("words") >= least_words))
    keyed = words.withColumns({"k1": F.xxhash64("words"), "k2": F.xxhash64(F.lit(1), "words")})
    sets = written(keyed.groupBy("k1", "k2", "words").agg(F.min("id").alias("rep")).withColumn("row", F.monotonically_increasing_id()))
    members = keyed.select("id", "k1", "k2").distinct().join(sets.select("k1", "k2", "rep"), ["k1", "k2"]).select("id", "rep")
    n = sets.count()
    counts = sets.select("words").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # at most COMMON_PARTS times the mean number of words of a set
    common = {r[0]: r[1] for r in counts.where(F.col("n") > n / COMMON_PARTS).collect()}
    shared = df.sparkSession.sparkContext.broadcast(common)
    buckets = max(1, ceil(n * KEYS_OF_A_SET / BUCKET_KEYS))
    large = one_word_classes(sets, common, threshold)
    grouped = sets.select("row", "words", F.lit(None).cast("long").alias("class")) if large is None else sets.select("row", "words").join(large.select("row", "class"), "row", "left")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scatter(shared.value, n, threshold, BLOCK_SETS, buckets)(batches)

    packed = grouped.mapInArrow(scatter, "bucket long, high long, keys binary, lows binary, maps binary, sizes binary, classes binary")
    pairs = written(packed.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(_gather(threshold), "x long, y long").distinct())
    with_x = pairs.join(sets.select(F.col("row").alias("x"), F.col("rep").alias("rx"), F.col("words").alias("wx")), "x")
    both = with_x.join(sets.select(F.col("row").alias("y"), F.col("rep").alias("ry"), F.col("words").alias("wy")), "y")
    common_words = F.size(F.array_intersect("wx", "wy"))
    checked = both.select("rx", "ry", common_words.alias("c"), (F.size("wx") + F.size("wy") - common_words).alias("u"))
    links = checked.where(F.col("c") >= F.col("u") * threshold - 1e-9)
    classes = None
    if large is not None:
        classes = large.join(sets.select("row", "rep"), "row").select(F.col("rep").alias("id"), "class", (2 / (F.col("size") + 1)).alias("distance"))
    return members, links.select(F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b"), (1 - F.col("c") / F.col("u")).alias("distance")), classes
