"""Cross-document line frequency: lines that many documents of a host share are removed, depleted documents rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.joins import lookup_join

MOST_DOCUMENTS = 5
LEAST_KEPT = 0.5


def normal_line(line: Column) -> Column:
    """Letters in lower case and single blanks; digits, punctuation and spacing only separate."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))


def line_frequency(df: DataFrame, doc: str, host: str, text: str, most_documents: int = MOST_DOCUMENTS, least_kept: float = LEAST_KEPT) -> DataFrame:
    """(doc, n_lines, n_removed, n_words, kept_words, kept_share, rejected), one row for each document.

    Lines end with a line feed, a carriage return or both, and are compared
    without letter case, digits and punctuation; lines without letters are no
    lines. A line is removed from all documents of a host where more than
    ``most_documents`` of them hold it, and a document with less than
    ``least_kept`` of its words left is rejected. Documents without host share
    one. Null, empty and wordless texts have no lines, share 1 and are kept.
    Rows without ``doc`` are left out; of a ``doc`` on several rows the lines
    of all distinct texts count together. An empty table gives no rows.

    Lines travel as 128-bit hashes. They are counted by document where they are
    read, then by host and line; a line that a third of all documents hold is
    one row from each task. Only lines above the limit are joined back, broadcast
    if few by their count, else salted.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\r\n|\n|\r"), normal_line), lambda x: x != "")
    packed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), F.size(F.split(x, " ")).cast("long").alias("words")))
    rows = df.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), packed.alias("lines"))
    rows = rows.groupBy("doc", "host").agg(F.flatten(F.collect_set("lines")).alias("lines"))  # rows delivered twice hold equal lines
    held = rows.select("doc", "host", F.explode("lines").alias("line")).groupBy("doc", "host", "line.h1", "line.h2").agg(
        F.count(F.lit(1)).alias("n"), F.sum("line.words").alias("words")
    )
    shared = held.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > most_documents)
    key = F.struct("host", "h1", "h2")
    marked = lookup_join(held.withColumn("key", key), shared.select(key.alias("key"), F.lit(True).alias("removed")), "key", "doc")
    gone = F.coalesce("removed", F.lit(False))
    sums = marked.groupBy("doc").agg(
        F.sum("n").alias("n_lines"), F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("n_removed"),
        F.sum("words").alias("n_words"), F.sum(F.when(gone, 0).otherwise(F.col("words"))).alias("kept_words"),
    )
    every = rows.select("doc").distinct().join(sums, "doc", "left").na.fill(0)
    share = F.when(F.col("n_words") > 0, F.col("kept_words") / F.col("n_words")).otherwise(F.lit(1.0))
    return every.select(F.col("doc").alias(doc), "n_lines", "n_removed", "n_words", "kept_words", share.alias("kept_share"), (share < least_kept).alias("rejected"))
