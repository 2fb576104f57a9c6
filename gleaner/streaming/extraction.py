"""Extraction from files as they arrive: every batch of new passages runs through the request once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.plans.request import Criteria, Settings, apply
from gleaner.session import written
from gleaner.sources.sinks import append_field
from gleaner.streaming.events import run_available


def extract_arrivals(passages: DataFrame, files: DataFrame, criteria: list[Criteria], path: str, checkpoint: str, settings: Settings | None = None) -> None:
    """Rank each micro-batch of a stream of passages and append its facts under ``path`` by criterion and batch.

    A batch that is run again after a failure replaces its own facts.
    """

    def sink(batch: DataFrame, number: int) -> None:
        kept = written(batch.dropDuplicates(["hit_id"]))
        if not kept.isEmpty():
            facts = apply(kept, files, criteria, settings).select("criteria_uid", "file_idx", "hit_id", "group_id", "rank", F.round("final_score", 6).alias("score"), "answer", "formatted_answer")
            append_field(facts, path, str(number), ["criteria_uid"])

    run_available(passages, sink, checkpoint, "append")
