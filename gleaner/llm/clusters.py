"""Clusters of similar records by density peaks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.forest import candidates, exact_pairs, usable, weights_of_near
from gleaner.llm.set_join import similar_sets
from gleaner.operators.graph import connected_components
from gleaner.session import written

#: Where densities are counted without links, about so many vectors are compared with as many in one group.
TILE_ROWS = 16_384


def density_peaks(links: DataFrame, weights: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(id, density, parent, distance, peak) for every record in ``links`` (a, b, distance) or ``weights`` (id, weight).

    All records of a class of ``classes`` (id, class, distance) are neighbours at
    its distance, without links: their weights count, and the densest of them is
    the neighbour that the others have in their class.

    Density is the weight of a record and its neighbours. Parent is the nearest
    neighbour that is denser (of equally dense ones, the lower id is denser; of
    equally near ones, the lower id is taken); records without one are peaks.
    Peak is where the parents lead, found by doubling the pointers.
    """
    both = links.select("a", "b", "distance").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    near = both.join(weights.select(F.col("id").alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("near"))
    if classes is not None:
        weighed = classes.join(weights, "id")
        whole = weighed.groupBy("class").agg(F.sum("weight").alias("whole"))
        inside = weighed.join(whole, "class").select(F.col("id").alias("a"), (F.col("whole") - F.col("weight")).alias("near"))
        near = near.unionByName(inside).groupBy("a").agg(F.sum("near").alias("near"))
    density = written(
        weights.join(near, weights.id == near.a, "left").select("id", (F.col("weight") + F.coalesce("near", F.lit(0))).alias("density"))
    )
    of = lambda end: density.select(F.col("id").alias(end), F.col("density").alias(f"d{end}"))
    denser = both.join(of("a"), "a").join(of("b"), "b").where("db > da or (db = da and b < a)")
    denser = denser.select("a", "b", "distance")
    if classes is not None:
        denser = denser.unionByName(to_densest(classes, density).select("a", "b", "distance"))
    parents = denser.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("p"))
    nodes = written(
        density.join(parents, density.id == parents.a, "left").select("id", "density", F.col("p.b").alias("parent"), F.col("p.distance").alias("distance"))
    )
    pointer = nodes.select("id", F.coalesce("parent", "id").alias("to"))
    while True:
        onward = pointer.select(F.col("id").alias("to"), F.col("to").alias("next"))
        moved = written(pointer.join(onward, "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        pointer = moved.select("id", "to")
        if moved.where("moved").isEmpty():
            break
    return nodes.join(pointer.withColumnRenamed("to", "peak"), "id")


def to_densest(classes: DataFrame, density: DataFrame) -> DataFrame:
    """(a, b, distance) from every record of a class to the densest one, of equally dense ones that with the lowest id."""
    known = classes.join(density.select("id", "density"), "id")
    best = known.groupBy("class").agg(F.min(F.struct(-F.col("density"), F.col("id"))).alias("best"))
    return known.join(best, "class").select(F.col("id").alias("a"), F.col("best.id").alias("b"), "distance").where("a <> b")


def joined_clusters(links: DataFrame, members: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(id, rep, cluster, density): every member of a cluster of two or more; cluster is its smallest id.

    ``members`` (id, rep) gives each record's representative, ``links`` the
    similar representatives. Density peaks give the clusters; then peaks whose
    clusters any link joins are one, so that records similar directly or
    through others end together. ``classes`` as in ``density_peaks``.
    """
    links = written(links)
    weights = written(members.groupBy("rep").agg(F.count_distinct("id").alias("weight"), F.min("id").alias("id")).where("id is not null").select(F.col("rep").alias("id"), "weight"))
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    if classes is not None:
        classes = written(classes)
        ends = ends.unionByName(classes.select("id")).distinct()
    linked = written(ends.join(weights, "id"))
    labelled = written(density_peaks(links, linked, classes))
    peak = labelled.select("id", "peak")
    near = links.select("a", "b") if classes is None else links.select("a", "b").unionByName(to_densest(classes, labelled).select("a", "b"))
    crossing = (
        near.join(peak.select(F.col("id").alias("a"), F.col("peak").alias("pa")), "a")
        .join(peak.select(F.col("id").alias("b"), F.col("peak").alias("pb")), "b")
        .where("pa <> pb")
        .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        .distinct()
    )
    parts = connected_components(crossing)
    cluster = labelled.join(parts.withColumnRenamed("node", "peak"), "peak", "left").select(
        "id", "density", F.coalesce("component", "peak").alias("part")
    )
    first = cluster.groupBy("part").agg(F.min("id").alias("cluster"))
    named = cluster.join(first, "part").select(F.col("id").alias("rep"), "cluster", "density")
    copies = weights.where("weight > 1").join(ends, "id", "left_anti").select(F.col("id").alias("rep"), F.col("id").alias("cluster"), F.col("weight").alias("density"))
    return members.join(named.unionByName(copies), "rep").select("id", "rep", "cluster", "density").distinct()


def text_clusters(df: DataFrame, id: str, text: str, threshold: float = 0.75, least_words: int = 8) -> DataFrame:
    """``joined_clusters`` of texts with at least ``least_words`` distinct words by the overlap of their words.

    Null, empty and short texts and rows without id are in no cluster, rows
    delivered twice count once, an empty table has no clusters.
    """
    members, links, classes = similar_sets(df, id, text, threshold, least_words)
    return joined_clusters(links, written(members), classes)


def vector_clusters(df: DataFrame, id: str, vector: str, min_cosine: float = 0.9, d: int = 64) -> DataFrame:
    """``joined_clusters`` of usable vectors by their cosine; others are in no cluster.

    Equal vectors are collapsed first, however many there are. Where very many
    different vectors are similar to each other, only links that keep them
    together are made; the densities of those that have other neighbours, too,
    are then counted over all members of their cluster (``whole_densities``).
    """
    vec = F.col(vector)
    rows = df.select(F.col(id).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & usable(vec, d))
    keyed = rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})
    sets = written(keyed.groupBy("k1", "k2", "vec").agg(F.min("id").alias("rep")))
    members = keyed.select("id", "k1", "k2").distinct().join(sets.select("k1", "k2", "rep"), ["k1", "k2"]).select("id", "rep")
    found, reps, _, _ = candidates(sets.select("rep", "vec"), "rep", "vec", d, None, min_cosine)
    found = written(found)
    links = exact_pairs(found, reps, min_cosine).select("a", "b", (1 - F.col("cosine")).alias("distance"))
    joined = joined_clusters(links, written(members))
    marked = found.where("a = b").select(F.col("a").alias("rep"))
    if marked.isEmpty():
        return joined
    joined = written(joined)
    whole = whole_densities(joined, marked, reps, min_cosine, d).withColumnRenamed("density", "whole")
    return joined.join(whole, "rep", "left").select("id", "rep", "cluster", F.coalesce("whole", "density").alias("density"))


def whole_densities(clusters: DataFrame, asked: DataFrame, vectors: DataFrame, floor: float, d: int) -> DataFrame:
    """(rep, density) of the representatives ``asked`` (rep): their weight and that of all with a cosine of at least ``floor``.

    All of these are in the same one of the ``clusters`` (id, rep, cluster), with whose
    representatives each is compared, about ``TILE_ROWS`` with as many in a group.
    """
    tiles = lambda n: F.ceil(F.col(n) / TILE_ROWS).cast("int")
    part = lambda n: F.pmod(F.xxhash64(F.lit(1), "rep"), F.col(n)).cast("int")
    wanted = written(clusters.where("id = rep").join(asked, "rep", "left_semi").select("rep", "cluster"))
    asked_tiles = wanted.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).select("cluster", tiles("n").alias("asked_tiles"))
    weights = written(clusters.join(asked_tiles, "cluster").groupBy("cluster", "asked_tiles", "rep").agg(F.count_distinct("id").alias("weight")))
    own_tiles = weights.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).select("cluster", tiles("n").alias("own_tiles"))
    of = vectors.join(weights, vectors.id == weights.rep, "left_semi").groupBy(F.col("id").alias("rep")).agg(F.min("vec").alias("vec"))
    members = written(weights.join(own_tiles, "cluster").join(of, "rep"))
    left = members.join(wanted.select("rep"), "rep", "left_semi").select(
        "cluster", part("asked_tiles").alias("i"), F.explode(F.sequence(F.lit(0), F.col("own_tiles") - 1)).alias("j"), "rep", "vec"
    )
    right = members.select(
        F.col("cluster").alias("of"), F.explode(F.sequence(F.lit(0), F.col("asked_tiles") - 1)).alias("of_i"), part("own_tiles").alias("of_j"), "weight", F.col("vec").alias("own_vec")
    )

    def compare(queries: pa.Table, own: pa.Table) -> pa.Table:
        x, own_x = (c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for c in (queries.column("vec"), own.column("own_vec")))
        near = weights_of_near(x, own_x, own.column("weight").to_numpy().astype(np.float64), floor)
        return pa.table({"rep": queries.column("rep"), "near": pa.array(near, pa.int64())})

    compared = left.groupBy("cluster", "i", "j").cogroup(right.groupBy("of", "of_i", "of_j")).applyInArrow(compare, "rep long, near long")
    return compared.groupBy("rep").agg(F.sum("near").alias("density"))


def described(clusters: DataFrame, typical: int = 3) -> DataFrame:
    """(first_id, size, typical_ids): each cluster's size and its densest representatives, of equally dense ones those with lower ids."""
    sizes = clusters.groupBy("cluster").agg(F.count_distinct("id").alias("size"))
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.col("density").desc(), "rep"))
    top = clusters.where("id = rep").withColumn("rank", rank).where(F.col("rank") <= typical)
    named = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rep"))), lambda s: s["rep"]).alias("typical_ids"))
    return sizes.join(named, "cluster").select(F.col("cluster").alias("first_id"), "size", "typical_ids")
