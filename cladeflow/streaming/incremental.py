"""Profiles of a stream of alignments: batches add up, since a query's hits come in one file."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.profiles import merge
from ..plans.workflow import Hierarchy, assign
from ..operators.assignment import distinct_hits
from ..operators.counting import count_taxa


def profile_stream(hits: DataFrame, state: str, checkpoint: str, rank: str, hierarchy: Hierarchy | None = None, trigger: dict | None = None, **options) -> StreamingQuery:
    """Count a stream of hits (sample, query, subject) into Parquet folders under ``state``.

    Each batch writes its own unrounded counts to batch=N, so that a batch that is run again
    replaces what it wrote; ``stream_profile`` adds them up.
    """
    def add(batch: DataFrame, number: int) -> None:
        counted = count_taxa(assign(distinct_hits(batch), rank, hierarchy, **options))
        counted.write.mode("overwrite").parquet(os.path.join(state, f"batch={number}"))

    writer = hits.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_profile(spark, state: str) -> DataFrame:
    """The profile of all batches so far: sample, feature, value."""
    return merge(spark.read.parquet(state).select("sample", "feature", "value"), keys=("sample", "feature"))


def compact(spark, state: str) -> None:
    """Fold finished batches into one folder, for streams that run long. Not while the stream runs."""
    whole = stream_profile(spark, state)
    whole.write.mode("overwrite").parquet(f"{state}.new")
    shutil.rmtree(state)
    os.makedirs(state)
    shutil.move(f"{state}.new", os.path.join(state, "batch=-1"))
