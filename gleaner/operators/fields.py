"""Definitions of fields, and what is written back for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FIELDS = 1_000


def field_definitions(criteria: DataFrame, ids: list[str], most: int = MOST_FIELDS) -> list[dict]:
    """The rows of ``criteria`` with these criteria_uids, in the order asked for, as values of a request; the ids are those of one request.

    Null lists become empty, null numbers -1, null texts ''. Unknown ids are left out; more than ``most`` ids are an error.
    """
    if len(ids) > most:
        raise ValueError(f"{len(ids)} fields in one request, {most} are allowed")
    rows = {r["criteria_uid"]: r.asDict() for r in criteria.where(F.col("criteria_uid").isin(ids)).collect()} if ids else {}
    kinds = dict(criteria.dtypes)
    empty = lambda kind: [] if kind.startswith("array") else -1 if kind in ("int", "bigint", "double") else True if kind == "boolean" else ""
    return [{k: empty(kinds[k]) if v is None else v for k, v in rows[i].items()} for i in dict.fromkeys(ids) if i in rows]


def with_defaults(criteria: DataFrame) -> DataFrame:
    """``field_definitions`` of a whole table, as a table."""
    columns = []
    for name, kind in criteria.dtypes:
        default = F.array().cast(kind) if kind.startswith("array") else F.lit(-1).cast(kind) if kind in ("int", "bigint", "double") else F.lit(True) if kind == "boolean" else F.lit("") if kind == "string" else F.lit(None).cast(kind)
        columns.append(F.coalesce(F.col(name), default).alias(name))
    return criteria.select(*columns)


def derived_fields(facts: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """(key, field, value): one row for each rule that gives a value, to be written behind the facts it follows from."""
    values = F.array(*(F.struct(F.lit(name).alias("field"), rule.cast("string").alias("value")) for name, rule in rules.items()))
    return facts.select(*key, F.inline(F.filter(values, lambda v: v["value"].isNotNull())))


def in_task_order(facts: DataFrame, topic: str, order: list[str]) -> DataFrame:
    """``facts`` with ``topic_position``, the place of their topic in the task from 1 on; unknown topics come last."""
    place = F.array_position(F.array(*(F.lit(t) for t in order)).cast("array<string>"), F.col(topic))
    return facts.withColumn("topic_position", F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(F.lit(len(order) + 1)).cast("int"))
