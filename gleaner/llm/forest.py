"""Similar vectors by a forest of random-projection trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.session import written

TREES = 4
PROBES = 16
LEAF_ROWS = 256
#: Trees are broadcast, so they have at most 2**MAX_DEPTH leaves; beyond, leaves grow and are still compared whole.
MAX_DEPTH = 12
#: All margins of a level are taken at once while the trees have so many nodes there; deeper, only those of branches that can still be visited.
WIDE_NODES = 2_048
SAMPLE_ROWS = 16_384
CHUNK_ROWS = 16_384
#: A task compares the leaves of a tree that follow each other and hold about so many rows.
BUCKET_ROWS = 65_536
PART_ROWS = 16_384
BLOCK_ROWS = 4_096
HOT_PARTS = 10_000
#: So many equal vectors may meet in a leaf.
FEW_COPIES = 50
SPARE = 3
SEED = 3
#: What two bytes per element can be off by in a cosine.
ROUNDING = 0.001
#: Vectors whose true neighbours are sought before a forest is used.
QUERIES = 1_024
#: The visited leaves must hold this share of those neighbours, or all of them where a least cosine is asked for.
RECALL = 0.96
#: A block of a leaf with more links a row than this makes only those that keep its parts together; ``weights_of_near`` then counts all.
DENSE = 64
STRIP_ROWS = 512
#: The largest cosine of so many members each gives a bound for the k-th largest of all.
BOUND_ROWS = 64


def fit_trees(sample: np.ndarray, trees: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(normals, offsets) of complete trees: each node parts its sample by the bisector direction of two of its vectors, at the median."""
    rng = np.random.default_rng(seed)
    nodes, d = 2**depth - 1, sample.shape[1]
    normals, offsets = np.empty((trees, nodes, d), dtype=np.float32), np.zeros((trees, nodes), dtype=np.float32)
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = members.pop(node, np.empty(0, dtype=np.int64))
            normal = rng.standard_normal(d).astype(np.float32)
            if len(own) > 1:
                a, b = sample[rng.choice(own, 2, replace=False)]
                if np.linalg.norm(a - b) > 1e-6:
                    normal = a - b
            normals[t, node] = normal / np.linalg.norm(normal)
            if len(own):
                side = sample[own] @ normals[t, node]
                offsets[t, node] = np.median(side)
                if 2 * node + 2 < nodes:
                    right = side > offsets[t, node]
                    members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return normals, offsets


def visit_order(x: np.ndarray, forest: tuple[np.ndarray, np.ndarray], visits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the ``visits`` leaves that a queue shared by all trees gives out first, and which of them hold the vector.

    The queue holds branches by the sum of the squared distances to those
    planes on their path beyond which the vector doesn't lie; the nearer side
    keeps its branch's turn, so a branch's turn is that of its best leaf. The first
    ``visits`` leaves therefore lie below the first ``visits`` branches of every
    level, and a batch is served by keeping just these, level by level.
    """
    normals, offsets = forest
    trees, nodes, d = normals.shape
    depth = (nodes + 1).bit_length() - 1
    visits = min(max(visits, trees), trees << depth)
    turn = np.zeros((len(x), trees, 1), dtype=np.float32)
    home = np.zeros((len(x), trees), dtype=np.int64)
    level = 0
    while level < depth and trees << (level + 1) <= max(WIDE_NODES, 2 * visits):
        at = slice((1 << level) - 1, (2 << level) - 1)
        margin = (x @ normals[:, at].reshape(-1, d).T - offsets[:, at].reshape(-1)).reshape(len(x), trees, -1)
        right = np.take_along_axis(margin, home[:, :, None], axis=2)[:, :, 0] > 0
        turn = (turn[..., None] - np.maximum(np.stack([margin, -margin], axis=3), 0) ** 2).reshape(len(x), trees, -1)
        home = 2 * home + right
        level += 1
    width = 1 << level
    np.put_along_axis(turn, home[:, :, None], np.inf, axis=2)  # also where a margin is 0
    turn = turn.reshape(len(x), -1)
    keep = min(visits, trees * width)
    node = np.argpartition(-turn, keep - 1, axis=1)[:, :keep] if keep < trees * width else np.tile(np.arange(trees * width), (len(x), 1))
    turn = np.take_along_axis(turn, node, axis=1)
    tree, node = node >> level, node & (width - 1)
    while level < depth:
        at = (1 << level) - 1 + node
        margin = np.einsum("qvd,qd->qv", normals[tree, at], x) - offsets[tree, at]
        own = np.isposinf(turn)
        turn = np.minimum(turn, 0)
        left = np.where(own & (margin <= 0), np.inf, turn - np.maximum(margin, 0) ** 2)
        right = np.where(own & (margin > 0), np.inf, turn - np.maximum(-margin, 0) ** 2)
        turn, tree, node = np.concatenate([left, right], axis=1), np.tile(tree, 2), np.concatenate([2 * node, 2 * node + 1], axis=1)
        level += 1
        if turn.shape[1] > visits:
            first = np.argpartition(-turn, visits - 1, axis=1)[:, :visits]
            turn, tree, node = (np.take_along_axis(c, first, axis=1) for c in (turn, tree, node))
    return (tree << depth) + node, np.isposinf(turn)


def _visits(x: np.ndarray, forest: tuple[np.ndarray, np.ndarray], visits: int) -> tuple[np.ndarray, np.ndarray]:
    rows = max(64, min(4_096, 8_000_000 // (max(visits, WIDE_NODES) * 4)))
    parts = [visit_order(x[i : i + rows], forest, visits) for i in range(0, len(x), rows)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def pairs_in_block(
    ids: np.ndarray, x: np.ndarray, own: np.ndarray, own_x: np.ndarray, k: int | None, floor: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (place of a query, place of a member, cosine) from ``floor`` on; with ``k`` at least those among the ``k`` best of either.

    ``own`` is sorted. Every query is compared with every member, however many there are.
    """
    for at in range(0, len(ids), 1024):
        for col in range(0, len(own), BLOCK_ROWS):
            cosines = x[at : at + 1024] @ own_x[col : col + BLOCK_ROWS].T
            rows, cols = cosines.shape
            place = np.searchsorted(own[col : col + BLOCK_ROWS], ids[at : at + 1024])
            same = np.flatnonzero(own[np.minimum(col + place, len(own) - 1)] == ids[at : at + 1024])
            same = same[place[same] < cols]
            cosines[same, place[same]] = -2
            q, m = np.nonzero(cosines >= floor) if k is None or floor > -1 else ((), ())
            if k is not None and (floor <= -1 or len(q) > 2 * k * (rows + cols)):
                by_query, by_member = min(k, cols), min(k, rows)
                q = np.repeat(np.arange(rows), by_query)
                m = np.argpartition(cosines, cols - by_query, axis=1)[:, cols - by_query :].reshape(-1)
                turned = np.ascontiguousarray(cosines.T)
                m2 = np.repeat(np.arange(cols), by_member)
                q2 = np.argpartition(turned, rows - by_member, axis=1)[:, rows - by_member :].reshape(-1)
                both = np.unique(np.concatenate([q * cols + m, q2 * cols + m2]))
                q, m = np.divmod(both, cols)
                near = cosines[q, m]
                q, m = q[near >= max(floor, -1.5)], m[near >= max(floor, -1.5)]
            if len(q):
                yield at + q, col + m, cosines[q, m]


def links_in_block(ids: np.ndarray, x: np.ndarray, own: np.ndarray, own_x: np.ndarray, floor: float, sure: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, id, cosine) of the pairs of queries and members from ``floor`` on, and in dense blocks (id, id, 1) of both ends of pairs that are no links.

    In a block with more than ``DENSE`` pairs a row, a pair whose ends both have at
    least ``sure`` with one member, the hub, is no link: both are
    linked to the hub, so they stay connected. Who has such pairs is
    marked, and its neighbours are counted by ``weights_of_near``.
    """
    for at in range(0, len(ids), 1024):
        part, rows_x = ids[at : at + 1024], x[at : at + 1024]
        for col in range(0, len(own), BLOCK_ROWS):
            members, members_x = own[col : col + BLOCK_ROWS], own_x[col : col + BLOCK_ROWS]
            q, m, near = (np.concatenate(c) for c in zip(*(p for p in pairs_in_block(part, rows_x, members, members_x, None, floor)), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)), strict=True))
            most = DENSE * (len(part) + len(members))
            marked_query, marked_member = np.zeros(len(part), dtype=bool), np.zeros(len(members), dtype=bool)
            open_pairs = near >= sure
            while np.count_nonzero(open_pairs) > most:
                hub = np.bincount(m[open_pairs], minlength=len(members)).argmax()
                of_query = np.zeros(len(part), dtype=bool)
                of_query[q[open_pairs & (m == hub)]] = True
                to_hub = members_x @ members_x[hub]
                of_member = to_hub >= sure
                of_member[hub] = True
                covered = open_pairs & of_query[q] & of_member[m]
                star = covered & (m == hub)
                yield part[q[star]], np.full(np.count_nonzero(star), members[hub]), near[star]
                others = np.flatnonzero(of_member & (members != members[hub]))
                yield members[others], np.full(len(others), members[hub]), to_hub[others]
                marked_query[q[covered & ~star]] = True
                marked_member[m[covered & ~star]] = True
                keep = ~covered
                q, m, near, open_pairs = q[keep], m[keep], near[keep], open_pairs[keep]
            yield part[q], members[m], near
            marked = np.unique(np.r_[part[marked_query], members[marked_member]])
            yield marked, marked, np.ones(len(marked), dtype=np.float32)


def weights_of_near(x: np.ndarray, own_x: np.ndarray, weights: np.ndarray, floor: float) -> np.ndarray:
    """For each vector of ``x`` the weight of those of ``own_x`` with a cosine of at least ``floor``, near the floor by ``_cosine``'s order of sums."""
    x, own_x = x.astype(np.float64), own_x.astype(np.float64)
    square, own_square = (np.add.accumulate(v * v, axis=1)[:, -1] for v in (x, own_x))
    unit_x, own_unit = unit(x).astype(np.float32), unit(own_x).astype(np.float32)
    by_element, own_by_element = np.ascontiguousarray(x.T), np.ascontiguousarray(own_x.T)
    total = np.zeros(len(x), dtype=np.int64)
    for at in range(0, len(x), 1024):
        for col in range(0, len(own_x), BLOCK_ROWS):
            cosines = unit_x[at : at + 1024] @ own_unit[col : col + BLOCK_ROWS].T
            near = cosines >= floor + ROUNDING
            q, m = np.nonzero((cosines >= floor - ROUNDING) & ~near)
            dot = np.zeros(len(q))
            for p, o in zip(by_element, own_by_element, strict=True):
                dot += p[at + q] * o[col + m]
            near[q, m] = dot / np.sqrt(square[at + q] * own_square[col + m]) >= floor
            total[at : at + 1024] += (near.astype(np.float64) @ weights[col : col + BLOCK_ROWS]).astype(np.int64)
    return total


def best_of_each(a: np.ndarray, b: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` nearest of each ``a``, of equally near ones those with lower ``b``."""
    order = np.lexsort((b, -near, a))
    if not len(order):
        return order
    new = np.r_[True, a[order][1:] != a[order][:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def nearest_of_all(
    ids: np.ndarray, x: np.ndarray, own: np.ndarray, own_x: np.ndarray, k: int, floor: float, farthest: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, cosine) of the ``k`` most similar members of each query, from ``floor`` on, each compared with all members; not the query itself.

    With ``farthest`` the ``k`` least similar ones from ``floor`` on.
    """
    found = []
    parts = len(own) // BOUND_ROWS
    for at in range(0, len(ids), STRIP_ROWS):
        cosines = x[at : at + STRIP_ROWS] @ own_x.T
        if farthest:
            cosines = np.where(cosines >= floor, -cosines, np.float32(-2))
        least = np.full(len(cosines), -1.5 if farthest else max(floor, -1.5), dtype=np.float32)
        if parts > k:  # k + 1 parts hold a member from here on, and one of these may be the query
            tops = cosines[:, : parts * BOUND_ROWS].reshape(len(cosines), parts, BOUND_ROWS).max(axis=2)
            least = np.maximum(least, np.partition(tops, parts - k - 1, axis=1)[:, parts - k - 1])
        q, m = np.divmod(np.flatnonzero(cosines >= least[:, None]), len(own))
        other = ids[at + q] != own[m]
        q, m = q[other], m[other]
        near = cosines[q, m]
        order = np.lexsort((own[m], -near, q))
        q, m, near = q[order], m[order], near[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, dtype=np.int64)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        found.append((ids[at + q[place < k]], own[m[place < k]], -near[place < k] if farthest else near[place < k]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _chunks(batches: Iterator[pa.RecordBatch], d: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of about ``chunk`` rows at a time."""
    held_ids, held_x, rows = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held_ids.append(batch.column(0).to_numpy())
        held_x.append(unit(batch.column(1).flatten().to_numpy().astype(np.float32).reshape(-1, d)))
        rows += batch.num_rows
        if rows >= chunk:
            yield np.concatenate(held_ids), np.concatenate(held_x)
            held_ids, held_x, rows = [], [], 0
    if rows:
        yield np.concatenate(held_ids), np.concatenate(held_x)


def _coded(x: np.ndarray) -> np.ndarray:
    return np.rint(x * (32_767 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int16)


def enough_visits(rows: DataFrame, n: int, forest: tuple[np.ndarray, np.ndarray], d: int, k: int | None, floor: float, least: int) -> int:
    """The visits, from ``least`` on, with which a sample's vectors reach ``RECALL`` of their ``k`` nearest.

    Without ``k`` all pairs from ``floor`` on are wanted; then it is the five nearest
    and, as the hardest to find, the five farthest of these that must be found.

    The sample is compared with every row. A neighbour counts where a leaf
    that holds either vector is visited by the other. Where a least cosine is
    asked for, all neighbours must be found, and the visits are doubled once
    more. A visit of all leaves of a tree finds everything, so visits end there.
    """
    part = min(1.0, QUERIES / max(1, n))
    drawn = F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(1_000_000)) < max(1, int(part * 1_000_000))
    sample = rows.where(drawn).select("id", "vec").limit(4 * QUERIES).toArrow()
    if not sample.num_rows:
        return least
    ids, first = np.unique(sample.column(0).to_numpy(), return_index=True)
    x = unit(sample.column(1).combine_chunks().flatten().to_numpy().astype(np.float32).reshape(-1, d))[first]
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))
    sides, k = (False,) if k else (False, True), k or 5

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, own_x in _chunks(batches, d, CHUNK_ROWS // 2):
            own, at = np.unique(own, return_index=True)
            own_x = own_x[at]
            for far in sides:
                a, b, near = nearest_of_all(*shared.value, own, own_x, k, floor, far)
                vectors = own_x[np.searchsorted(own, b)]
                columns = [pa.array(a), pa.array(b), pa.array(near), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(np.full(len(a), far))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "near", "vec", "far"])

    turn = F.row_number().over(W.partitionBy("a", "far").orderBy(F.when(F.col("far"), F.col("near")).otherwise(-F.col("near")), "b"))
    nearest = rows.select("id", "vec").mapInArrow(compare, "a long, b long, near float, vec binary, far boolean").withColumn("turn", turn).where(F.col("turn") <= k)
    true = nearest.select("a", "vec").toArrow()  # k rows, or twice as many, for each of the sample
    shared.unpersist()
    if not true.num_rows:
        return least
    query = np.searchsorted(ids, true.column(0).to_numpy())
    others = np.frombuffer(b"".join(true.column(1).to_pylist()), np.float32).reshape(-1, d)
    trees, leaves = len(forest[0]), forest[0].shape[1] + 1

    def homes(y: np.ndarray) -> np.ndarray:
        at, home = _visits(y, forest, trees)
        return np.sort(at[home].reshape(-1, trees), axis=1)

    def seen(y: np.ndarray, homes_of: np.ndarray, visits: int) -> np.ndarray:
        at, _ = _visits(y, forest, visits)
        found = np.zeros(len(y), dtype=bool)
        for t in range(trees):
            found |= (at == homes_of[:, t, None]).any(axis=1)
        return found

    of_query, of_other = homes(x)[query], homes(others)
    visits, wanted = least, RECALL if floor <= -1 else 1.0
    while visits < leaves:
        found = np.zeros(len(others), dtype=bool)
        for i in range(0, len(others), 1024):
            part = slice(i, i + 1024)
            found[part] = seen(x[query[part]], of_other[part], visits) | seen(others[part], of_query[part], visits)
        if found.mean() >= wanted:
            return min(leaves, visits if floor <= -1 else 2 * visits)
        visits = min(leaves, visits + max(1, visits // 2))
    return leaves


def _scatter(forest: tuple[np.ndarray, np.ndarray], visits: int, d: int, chunk: int, per_bucket: int) -> Callable:
    """Vectors, two bytes per element, packed by the bucket of leaves they visit: each once, with its visits, those of its own leaf first."""
    leaves = forest[0].shape[1] + 1
    per_tree = -(-leaves // per_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _chunks(batches, d, chunk):
            for i in range(0, len(ids), 65_536):
                yield flush(ids[i : i + 65_536], x[i : i + 65_536])

    def flush(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        leaf, home = _visits(x, forest, visits)
        codes = _coded(x)
        row = np.repeat(np.arange(len(x)), leaf.shape[1])
        leaf, home = leaf.reshape(-1), home.reshape(-1)
        tree, place = np.divmod(leaf, leaves)
        bucket, place = tree * per_tree + place // per_bucket, place % per_bucket
        order = np.lexsort((row, ~home, bucket))
        row, place, home, bucket = row[order], place[order], home[order], bucket[order]
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        columns: tuple[list, ...] = ([], [], [], [], [], [])
        for a, b in zip(start, np.r_[start[1:], len(bucket)], strict=True):
            rows, at = np.unique(row[a:b], return_inverse=True)
            values = (bucket[a], home[a:b].sum(), ids[rows].tobytes(), codes[rows].tobytes(), at.astype(np.uint16).tobytes(), place[a:b].astype(np.uint16).tobytes())
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "homes", "ids", "codes", "at", "places"])

    return run


def _search(d: int, k: int | None, floor: float, parts: int) -> Callable:
    """Compares every vector with the members of the leaves it visits; the best of a bucket leave it packed by the part of their query."""

    def packed(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        a, b, near, part = a[order], b[order], near[order].astype(np.float32), part[order]
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        cuts = list(zip(start, np.r_[start[1:], len(part)], strict=True))
        blobs = (pa.array([c[i:j].tobytes() for i, j in cuts], pa.binary()) for c in (a, b, near))
        return pa.RecordBatch.from_arrays([pa.array(part[start], pa.int32()), *blobs], names=["part", "a", "b", "near"])

    def bucket_pairs(blobs: list) -> Iterator[pa.RecordBatch]:
        own_ids, own_codes, own_place = [], [], []
        for homes, ids, codes, at, place in blobs:
            own_ids.append(ids[at[:homes]])
            own_codes.append(codes[at[:homes]])
            own_place.append(place[:homes])
        own, own_codes, own_place = np.concatenate(own_ids), np.concatenate(own_codes), np.concatenate(own_place)
        order = np.lexsort((own, own_place))
        order = order[np.r_[True, (own[order][1:] != own[order][:-1]) | (own_place[order][1:] != own_place[order][:-1])]] if len(order) else order
        own, own_place, own_x = own[order], own_place[order], unit(own_codes[order].astype(np.float32))
        kept: list[tuple[np.ndarray, ...]] = []  # the best of each member so far
        seen = np.empty(0, dtype=np.int64)
        for _, ids, codes, at, place in blobs:
            fresh = np.zeros(len(ids), dtype=bool)  # rows delivered twice
            fresh[np.unique(ids, return_index=True)[1]] = True
            fresh &= ~np.isin(ids, seen)
            seen = np.concatenate([seen, ids[fresh]])
            at, place = at[fresh[at]], place[fresh[at]]
            if not len(at):
                continue
            x = unit(codes.astype(np.float32))
            order = np.argsort(place, kind="stable")
            at, place = at[order], place[order]
            start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            found = []
            for i, j in zip(start, np.r_[start[1:], len(place)], strict=True):
                lo, hi = np.searchsorted(own_place, [place[i], place[i] + 1])
                if lo < hi and k is None:
                    rows = at[i:j]
                    found += links_in_block(ids[rows], x[rows], own[lo:hi], own_x[lo:hi], floor, floor + 2 * ROUNDING)
                elif lo < hi:
                    rows = at[i:j]
                    found += [(rows[q], lo + m, near) for q, m, near in pairs_in_block(ids[rows], x[rows], own[lo:hi], own_x[lo:hi], k, floor)]
            if not found:
                continue
            q, m, near = (np.concatenate(c) for c in zip(*found, strict=True))
            if k is None:
                if len(q):
                    yield packed(np.minimum(q, m), np.maximum(q, m), near)
                continue
            best = best_of_each(ids[q], own[m], near, k)
            yield packed(ids[q[best]], own[m[best]], near[best])
            kept.append((own[m], ids[q], near))
            a, b, near = (np.concatenate(c) for c in zip(*kept, strict=True))
            best = best_of_each(a, b, near, k)
            kept = [(a[best], b[best], near[best])]
        if kept and len(kept[0][0]):
            yield packed(*kept[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, list] = {}
        for batch in batches:
            for bucket, homes, ids, codes, at, place in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                buckets.setdefault(bucket, []).append(
                    (homes, np.frombuffer(ids, np.int64), np.frombuffer(codes, np.int16).reshape(-1, d), np.frombuffer(at, np.uint16), np.frombuffer(place, np.uint16))
                )
        for bucket in list(buckets):
            yield from bucket_pairs(buckets.pop(bucket))

    return run


def _merge(k: int | None) -> Callable:
    """Distinct pairs of a part, with ``k`` the best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, a, b, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(part, []).append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(near, np.float32)))
        for part in list(held):
            a, b, near = (np.concatenate(c) for c in zip(*held.pop(part), strict=True))
            order = np.lexsort((b, a))
            order = order[np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]]
            a, b, near = a[order], b[order], near[order]
            best = slice(None) if k is None else best_of_each(a, b, near, k)
            yield from pa.Table.from_arrays([pa.array(a[best]), pa.array(b[best]), pa.array(near[best])], names=["a", "b", "near"]).to_batches(max_chunksize=100_000)

    return run


def usable(vector: Column, d: int) -> Column:
    """Not null, ``d`` elements, none of them null, NaN or infinite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == d) & ~bad & F.exists(vector, lambda x: x != 0)


def _cosine(a: Column, b: Column) -> Column:
    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _without_copies(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows to index, the other copies of vectors that a large part of the rows share, and the copies kept of each.

    At most HOT_PARTS vectors can occur in more than 1/HOT_PARTS of the rows.
    """
    counts = rows.groupBy("copy").agg(F.count(F.lit(1)).alias("n"))
    least = max(FEW_COPIES, rows.count() // HOT_PARTS)
    hot = written(counts.where(F.col("n") > least).select("copy"))
    if hot.isEmpty():
        return rows, None, None
    copies = rows.join(F.broadcast(hot), "copy").select("copy", "id").distinct()
    rank = F.row_number().over(W.partitionBy("copy").orderBy("id"))
    lowest = written(copies.withColumn("rank", rank).where(F.col("rank") <= keep))  # keep rows for each of at most HOT_PARTS
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "copy", "left")
    kept = marked.join(F.broadcast(lowest.select("copy", "id", F.lit(True).alias("kept"))), ["copy", "id"], "left")
    return kept.where("hot is null or kept").select("copy", "id", "vec"), copies.join(F.broadcast(lowest), ["copy", "id"], "left_anti"), lowest


def candidates(
    df: DataFrame, id: str, vector: str, d: int, k: int | None, floor: float, trees: int = TREES, probes: int = PROBES, seed: int = SEED
) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """(pairs a, b, near; usable rows; copies left out; copies kept): leaf candidates of each usable vector, each pair once.

    Without ``k`` the pairs connect what all pairs from ``floor`` on connect; a row
    with a = b marks a vector that has other pairs, too.
    """
    vec = F.col(vector)
    copy = F.struct(F.xxhash64(vec), F.xxhash64(F.lit(1), vec))  # 128 bits
    rows = df.select(F.col(id).cast("long").alias("id"), vec.alias("vec"), copy.alias("copy")).where(F.col("id").isNotNull() & usable(vec, d))
    rows, left_out, kept = _without_copies(rows, (k or 0) + 1)
    rows = rows.select("id", "vec")
    n = rows.count()
    part = min(1.0, SAMPLE_ROWS / max(1, n))
    chosen = rows if part == 1.0 else rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(part * 1_000_000))
    sample = chosen.select("vec").limit(2 * SAMPLE_ROWS).toArrow()
    x = unit(sample.column(0).combine_chunks().flatten().to_numpy().astype(np.float32).reshape(-1, d)) if sample.num_rows else np.zeros((0, d), np.float32)
    x = x[np.lexsort(x.T)]  # the same trees whatever order the rows come in
    depth = int(np.clip(np.ceil(np.log2(max(1, n) / LEAF_ROWS)), 0, MAX_DEPTH))
    forest = fit_trees(x, trees if depth else 1, depth, seed)
    near = floor - ROUNDING if floor > -1 else floor
    visits = enough_visits(rows, n, forest, d, k, floor, probes) if depth else 1
    leaves = 1 << depth
    if visits >= leaves:  # every leaf of one tree: all vectors are compared with all
        forest, visits = (forest[0][:1], forest[1][:1]), leaves
    per_bucket = max(1, min(leaves, int(BUCKET_ROWS * leaves / max(1, n))))
    buckets, parts = len(forest[0]) * -(-leaves // per_bucket), max(1, -(-n // PART_ROWS))
    shared = df.sparkSession.sparkContext.broadcast(forest)  # at most trees * 2**MAX_DEPTH vectors

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scatter(shared.value, visits, d, CHUNK_ROWS, per_bucket)(batches)

    most = None if k is None else k + SPARE
    packed = rows.mapInArrow(scatter, "bucket int, homes long, ids binary, codes binary, at binary, places binary").repartitionById(buckets, "bucket")
    found = packed.mapInArrow(_search(d, most, near, parts), "part int, a binary, b binary, near binary").repartitionById(parts, "part")
    return found.mapInArrow(_merge(most), "a long, b long, near float"), rows, left_out, kept


def exact_pairs(found: DataFrame, rows: DataFrame, floor: float) -> DataFrame:
    """(a, b, cosine) with a < b: the distinct pairs of ``found`` with their exact cosine, from ``floor`` on."""
    pairs = written(found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    vectors = written(rows.join(needed, "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec")))
    with_a = pairs.join(vectors.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a")
    both = with_a.join(vectors.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
    return both.select("a", "b", _cosine(F.col("va"), F.col("vb")).alias("cosine")).where(F.col("cosine") >= floor)


def similar_vectors(
    df: DataFrame, id: str, vector: str, d: int = 64, k: int = 5, min_cosine: float = -1.0, trees: int = TREES, probes: int = PROBES
) -> DataFrame:
    """(id, other, cosine, rank): the ``k`` vectors most similar to each usable vector, of equal ones those with the lower id.

    Usable vectors have ``d`` elements, none null, NaN or infinite, and are not
    all zero; others give no rows, nor do rows without id or an empty table.
    Rows delivered twice count once (of an id with several vectors the smallest is
    compared). Only pairs with at least ``min_cosine`` are given.

    The trees are fitted on a sample of about ``SAMPLE_ROWS`` vectors, every
    vector is indexed. Each lies in one leaf of every tree and visits the
    leaves of all trees whose turn in the shared queue comes first: ``probes``,
    or as many more as it takes to find a sample's true neighbours, up to all
    leaves of a tree. Whoever is compared is a candidate of both. The best
    candidates are reranked by the exact cosine. Vectors
    travel as two bytes per element. Where one vector is repeated in a large
    part of all rows, its ``k + 1`` lowest ids stand for it, and the other
    copies have the lowest of them as neighbours.
    """
    found, rows, left_out, kept = candidates(df, id, vector, d, k, min_cosine, trees, probes)
    pairs = exact_pairs(found, rows, min_cosine)
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "cosine").unionByName(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "cosine")
    )
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("cosine").desc(), "other"))
    nearest = both.withColumn("rank", rank).where(F.col("rank") <= k)
    if left_out is not None:
        firsts = kept.where(F.col("rank") <= k).select("copy", F.col("id").alias("other"), F.lit(1.0).alias("cosine"), "rank")
        nearest = nearest.unionByName(left_out.join(F.broadcast(firsts), "copy").select("id", "other", "cosine", "rank"))
    return nearest.select(F.col("id").cast(df.schema[id].dataType).alias("id"), F.col("other").cast(df.schema[id].dataType).alias("other"), "cosine", "rank")
