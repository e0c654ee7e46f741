"""Queue messages and broker gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobruns.functions.text import task_id_of

GAUGES = ("visible", "not_visible", "delayed")


def parse_messages(messages: DataFrame) -> DataFrame:
    """Add ``task_id`` and ``drop`` (no id in the body, the message is to be deleted). Works on a
    batch and on a stream."""
    return messages.withColumn("task_id", task_id_of(F.col("body"))).withColumn(
        "drop", F.col("task_id").isNull()
    )


def queue_samples(gauges: DataFrame) -> DataFrame:
    """One row per queue, time and gauge; a missing attribute reads 0."""
    ids = [c for c in gauges.columns if c not in GAUGES]
    zeroed = gauges.select(*ids, *[F.coalesce(F.col(g), F.lit(0)).cast("double").alias(g) for g in GAUGES])
    return zeroed.unpivot(ids, list(GAUGES), "metric", "value")
