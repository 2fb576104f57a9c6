"""Phrases of texts and clusters of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.joins import lookup_join


def phrases(text: Column, stop: list[str] | None = None, least: int = 1, most: int | None = None) -> Column:
    """Runs of words between stop words and punctuation, of ``least`` to ``most`` (None: any number of) words."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s])"), F.lit(1))
    cut = F.transform(pieces, lambda p: F.when(F.regexp_like(p, F.lit(r"^[^\p{L}\p{N}]")) | T.one_of(p, stop or T.STOP_WORDS), "|").otherwise(p))
    runs = F.transform(F.split(F.array_join(cut, " "), r"\|"), lambda r: F.trim(r))
    length = lambda r: F.size(F.split(r, " "))
    short = lambda r: F.lit(True) if most is None else length(r) <= most
    return F.filter(runs, lambda r: (r != "") & (length(r) >= least) & short(r) & ~F.regexp_like(r, F.lit(r"^[\p{N} ]+$")))


def distinct_phrases(texts: DataFrame, text: str, stop: list[str] | None = None, least: int = 1, most: int | None = None) -> DataFrame:
    return texts.select(F.explode(F.array_distinct(phrases(F.col(text), stop, least, most))).alias("phrase")).distinct()


def word_stats(phrase_set: DataFrame) -> DataFrame:
    """(word, frequency, degree) over distinct phrases: each occurrence adds its phrase's length to the degree."""
    words = phrase_set.select(F.explode(F.split("phrase", " ")).alias("word"), F.size(F.split("phrase", " ")).alias("n"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"), F.sum("n").alias("degree"))


def phrase_scores(phrase_set: DataFrame) -> DataFrame:
    """(phrase, score): the sum of degree over frequency of the phrase's words."""
    words = phrase_set.select("phrase", F.posexplode(F.split("phrase", " ")).alias("pos", "word"))
    return words.join(word_stats(phrase_set), "word").groupBy("phrase").agg(F.round(F.sum(F.col("degree") / F.col("frequency")), 4).alias("score"))


def cluster_centres(rows: DataFrame, cluster: str, vector: str, d: int) -> DataFrame:
    """(cluster, centre): the mean vector, by position, without collecting a cluster."""
    parts = rows.select(cluster, F.posexplode(vector).alias("pos", "x")).groupBy(cluster, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return parts.groupBy(cluster).agg(centre.alias("centre"))


def cluster_titles(rows: DataFrame, cluster: str, label: str, vector: str, d: int) -> DataFrame:
    """(cluster, title): the label whose vector is nearest to the cluster's mean, the smallest of equally near ones."""
    from gleaner.functions.vectors import cosine

    joined = lookup_join(rows, cluster_centres(rows, cluster, vector, d), cluster, label, "inner")
    near = joined.select(cluster, label, F.round(cosine(F.col(vector), F.col("centre")), 6).alias("near"))
    return near.groupBy(cluster).agg(F.min(F.struct(-F.col("near"), F.col(label))).alias("best")).select(cluster, F.col(f"best.{label}").alias("title"))


def top_words(rows: DataFrame, cluster: str, text: str, n: int = 3, stop: list[str] | None = None) -> DataFrame:
    """(cluster, word, n, rank): the most frequent stems of each cluster's texts."""
    words = rows.select(cluster, F.explode(T.without(T.tokens(F.col(text)), stop or T.STOP_WORDS)).alias("w")).select(cluster, T.stem(F.col("w")).alias("word"))
    counts = words.where("length(word) > 2").groupBy(cluster, "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(cluster).orderBy(F.col("n").desc(), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def cluster_labels(rows: DataFrame, cluster: str, phrase: str, n: int = 5) -> DataFrame:
    """(cluster, phrase, n, rank): the most frequent normalised phrases of each cluster."""
    normal = F.trim(F.regexp_replace(F.lower(F.col(phrase)), T.SEPARATORS, " "))
    counts = rows.select(cluster, normal.alias("phrase")).where("phrase <> ''").groupBy(cluster, "phrase").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(cluster).orderBy(F.col("n").desc(), "phrase"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def rolled_up(rows: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Counts and sums by every prefix of the levels, from the whole to the finest."""
    return rows.rollup(*levels).agg(F.count(F.lit(1)).alias("members"), F.round(F.sum(value), 2).alias("total"), F.grouping_id().alias("level"))


def phrase_clusters(texts: DataFrame, id: str, text: str, k: int = 8, features: int = 256, seed: int = 5) -> DataFrame:
    """(id, cluster) of texts by their words: hashed counts weighted by rarity, reduced, then bisecting k-means."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    words = texts.select(id, T.without(T.tokens(F.col(text)), T.STOP_WORDS).alias("words")).where("size(words) > 0")
    steps = [
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="idf"),
        Normalizer(inputCol="idf", outputCol="unit"),
        BisectingKMeans(featuresCol="unit", predictionCol="cluster", k=k, seed=seed, maxIter=10),
    ]
    return Pipeline(stages=steps).fit(words).transform(words).select(id, "cluster")
