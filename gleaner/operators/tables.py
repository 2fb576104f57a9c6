"""Answers from tables kept as cells: (table_id, row_idx, col_idx, row_label, col_label, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_lines(index: DataFrame, share: float = 1.0) -> DataFrame:
    """Rows and columns of the hit index (table_id, type row/col/other, idx, score) that reach ``share`` of their type's best."""
    best = index.groupBy("table_id", "type").agg(F.max("score").alias("__best"))
    return index.join(best, ["table_id", "type"]).where(F.col("score") >= F.col("__best") * share).drop("__best")


def table_scores(index: DataFrame) -> DataFrame:
    """(table_id, row_score, col_score, other_score): the best of each type, 0 if there is none."""
    top = lambda kind: F.coalesce(F.max(F.when(F.col("type") == kind, F.col("score"))), F.lit(0.0))
    return index.groupBy("table_id").agg(top("row").alias("row_score"), top("col").alias("col_score"), top("other").alias("other_score"))


def rescaled(match_score: Column, row: Column, col: Column, other: Column) -> Column:
    return F.least(F.lit(1.0), match_score * (row + col + other) * F.greatest(row, col, other))


def sliced(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells of the chosen rows and columns; where only one kind is chosen, all of the other; the whole table where none is."""
    rows = lines.where("type = 'row'").select("table_id", F.col("idx").alias("row_idx")).distinct().withColumn("__r", F.lit(True))
    cols = lines.where("type = 'col'").select("table_id", F.col("idx").alias("col_idx")).distinct().withColumn("__c", F.lit(True))
    kinds = lines.groupBy("table_id").agg(F.bool_or(F.col("type") == "row").alias("__rows"), F.bool_or(F.col("type") == "col").alias("__cols"))
    joined = cells.join(kinds, "table_id", "left").join(rows, ["table_id", "row_idx"], "left").join(cols, ["table_id", "col_idx"], "left")
    keep = (F.coalesce("__r", F.lit(False)) | ~F.coalesce("__rows", F.lit(False))) & (F.coalesce("__c", F.lit(False)) | ~F.coalesce("__cols", F.lit(False)))
    return joined.where(keep).select(*cells.columns)


def cleaned(cells: DataFrame) -> DataFrame:
    """Placeholder labels blanked; rows with an empty cell dropped, then columns with one."""
    blank = lambda c: F.when(F.regexp_like(F.col(c), F.lit(r"^(_UNKNOWN_|_MULTI|\d+$)")), "").otherwise(F.col(c))
    named = cells.withColumns({"row_label": blank("row_label"), "col_label": blank("col_label")})
    bad_rows = named.where("value is null").select("table_id", "row_idx").distinct()
    kept = named.join(bad_rows, ["table_id", "row_idx"], "left_anti")
    bad_cols = kept.where("value is null").select("table_id", "col_idx").distinct()
    return kept.join(bad_cols, ["table_id", "col_idx"], "left_anti")


def outcome(display_cells: Column, answer_cells: Column, mean_words: Column, relevancy: Column) -> tuple[Column, Column]:
    """(table score, has answer) by the size of what was cut out."""
    score = (
        F.when(display_cells == 0, 0.0)
        .when(answer_cells == 0, 0.9)
        .when(answer_cells == 1, 1.0)
        .when(mean_words >= 5, 0.3)
        .otherwise(0.75)
    )
    return score, F.when(display_cells == 0, False).when(answer_cells == 0, relevancy > 0.9).otherwise(True)


def grid(cells: DataFrame) -> DataFrame:
    """(table_id, row_idx, row): label and values of every row by column, as JSON."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "value"))), lambda x: F.coalesce(x["value"], F.lit("")))
    rows = cells.groupBy("table_id", "row_idx", "row_label").agg(values.alias("__values"))
    return rows.select("table_id", "row_idx", F.to_json(F.concat(F.array("row_label"), "__values")).alias("row"))


def key_values(cells: DataFrame) -> DataFrame:
    """(table_id, key_values): the first row as 'label', then 'column: value' lines."""
    first = cells.groupBy("table_id").agg(F.min("row_idx").alias("row_idx"))
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("col_idx", "col_label", "value"))),
        lambda x: F.concat(x["col_label"], F.lit(": "), F.coalesce(x["value"], F.lit(""))),
    )
    rows = cells.join(first, ["table_id", "row_idx"]).groupBy("table_id", "row_label").agg(F.array_join(lines, "\n").alias("__lines"))
    return rows.select("table_id", F.concat("row_label", F.lit("\n"), "__lines").alias("key_values"))
