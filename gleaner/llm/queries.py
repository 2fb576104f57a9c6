"""The pN_ queries over the tables of one data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.clusters import described, text_clusters, vector_clusters
from gleaner.llm.forest import similar_vectors
from gleaner.llm.line_frequency import line_frequency
from gleaner.llm.mixing import language, mix, mix_report, source_name
from gleaner.llm.packing import pack
from gleaner.llm.rank_fusion import fuse_rankings, significance_of_firsts
from gleaner.llm.repetition import repetition
from gleaner.llm.term_stats import marked_terms
from gleaner.llm.tokens import token_counts
from gleaner.llm.top_n import top_n
from gleaner.session import written
from gleaner.sources.tables import read_table

FUSED = ("match_score", "sif_score", "dpr_score", "cross_encoder_score")


def p1_term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = read_table(spark, sf_dir, "query_builders")
    matches = read_table(spark, sf_dir, "matches")
    return marked_terms(keywords, "query_id", "keywords", "keywords", "keywords", 2, 5).unionByName(
        marked_terms(matches, "hit_id", "match_text", "words", "match_text", 2, 28)
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_term_statistics(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def set_score(name: str) -> Column:
    """A score, null where it is not set (-1 in match_score)."""
    score = F.col(name)
    return F.when(score != -1, score) if name == "match_score" else score


def p2_top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = read_table(spark, sf_dir, "raw_scores").select("file_idx", "match_idx", set_score("match_score").alias("match_score"))
    return top_n(scores, "file_idx", "match_idx", "match_score", 3)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_top_matches(spark, sf_dir).select("file_idx", "match_idx")


def clusters(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "match_text": text_clusters(read_table(spark, sf_dir, "matches"), "hit_id", "match_text", 0.75, 8),
        "query_sif_embeddings": vector_clusters(read_table(spark, sf_dir, "query_builders"), "query_id", "query_sif_embeddings", 0.9),
    }


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        c.where("id <> cluster").select(F.lit(field).alias("field"), F.col("cluster").alias("first_id"), F.col("id").alias("member_id"))
        for field, c in clusters(spark, sf_dir).items()
    ]
    return found[0].unionByName(found[1])


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [described(c).select(F.lit(field).alias("field"), "*") for field, c in clusters(spark, sf_dir).items()]
    return found[0].unionByName(found[1])


VECTORS = ("query_sif_embeddings", "query_dpr_embeddings")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = read_table(spark, sf_dir, "query_builders")
    found = [
        similar_vectors(queries, "query_id", field, k=5, min_cosine=0.9)
        .select(F.lit(field).alias("field"), F.least("id", "other").alias("query_id_a"), F.greatest("id", "other").alias("query_id_b"))
        .distinct()
        for field in VECTORS
    ]
    return found[0].unionByName(found[1])


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = read_table(spark, sf_dir, "query_builders")
    found = [similar_vectors(queries, "query_id", field, k=5).select(F.lit(field).alias("field"), "*") for field in VECTORS]
    return found[0].unionByName(found[1])


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse_rankings(
        read_table(spark, sf_dir, "raw_scores"), "criteria_uid", ["file_idx", "match_idx"], {s: set_score(s) for s in FUSED}
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # who leads three scores is that significant; the check: an average rank of 1 is the single highest value
    significant = F.col("rho") <= significance_of_firsts(F.col("n_items"), 3, len(FUSED))
    firsts = sum((F.coalesce(F.col(f"{s}_rank") == 1, F.lit(False)).cast("int") for s in FUSED), F.lit(0))
    return p6_ranking(spark, sf_dir).where((F.col("n_items") >= 8) & significant & (firsts >= 3)).select("criteria_uid", "file_idx", "match_idx")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(token_counts(read_table(spark, sf_dir, "documents"), ["doc_id"], "text"))
    specs = read_table(spark, sf_dir, "bin_specs").where("spec_id is not null and capacity_tokens > 0").distinct().collect()
    if not specs:
        return spark.createDataFrame([], "spec_id string, container long, doc_id long, piece int, first_token long, n_tokens long")
    packed = [pack(sizes, "doc_id", "n_tokens", r["capacity_tokens"]).withColumn("spec_id", F.lit(r["spec_id"])) for r in specs]
    whole = packed[0]
    for other in packed[1:]:
        whole = whole.unionByName(other)
    return whole.select("spec_id", "container", "doc_id", "piece", "first_token", "n_tokens")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = p7_packing(spark, sf_dir).where("container is not null").groupBy("spec_id").agg(
        F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens")
    )
    specs = read_table(spark, sf_dir, "bin_specs").distinct()
    share = F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    return filled.join(specs, "spec_id").select("spec_id", "capacity_tokens", "containers", "tokens", share.alias("filled_share"))


def _sizes(spark: SparkSession, sf_dir: str, targets: DataFrame) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").withColumn("source", source_name(F.col("source")))
    asked = targets.select(source_name(F.col("source")).alias("source")).distinct()
    drawn = documents.join(asked, "source", "left_semi").withColumn("lang", language(F.col("lang")))
    return written(token_counts(drawn, ["doc_id", "source", "lang"], "text"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read_table(spark, sf_dir, "mix_targets")
    return mix(_sizes(spark, sf_dir, targets), targets)


def p8_large_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reached shares of mixes as large as a quarter of the tokens of all sources asked for: scarce sources are used up, and their shortages redistributed."""
    targets = read_table(spark, sf_dir, "mix_targets")
    sizes = _sizes(spark, sf_dir, targets)
    total = (sizes.agg(F.sum("n_tokens")).first()[0] or 0) // 4
    mixes = [r[0] for r in targets.select("mix_id").where("mix_id is not null").distinct().collect()]
    return mix_report(mix(sizes, targets, dict.fromkeys(mixes, total)), targets)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(p8_mix(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(read_table(spark, sf_dir, "documents"), "doc_id", "text", 8)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_repetition(spark, sf_dir).where("n_words > 0 and n_repeated * 10 >= n_words * 3").select("doc_id").distinct()


def p9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    return line_frequency(documents, "doc_id", "source", "text")


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_term_statistics": p1_term_statistics,
        "p2_found": p2_found,
        "p2_top_matches": p2_top_matches,
        "p3_found": p3_found,
        "p3_clusters": p3_clusters,
        "p5_found": p5_found,
        "p5_neighbours": p5_neighbours,
        "p6_found": p6_found,
        "p6_ranking": p6_ranking,
        "p7_packing": p7_packing,
        "p7_report": p7_report,
        "p8_mix": p8_mix,
        "p8_large_mix": p8_large_mix,
        "p8_report": p8_report,
        "p9_found": p9_found,
        "p9_line_frequency": p9_line_frequency,
        "p9_repetition": p9_repetition,
    }
