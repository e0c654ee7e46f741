"""Queue depth over time from the message log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobruns.functions.times import truncated
from jobruns.operators.slices import running_totals


def queue_depth_timeline(messages: DataFrame, bucket: str = "minute") -> DataFrame:
    """Waiting and in-flight messages per queue after each bucket of time in which one moved.

    ``messages``: ``queue, ts, op`` with op send, receive, delete or return. The log is reduced to
    buckets before any running sum."""
    op = F.col("op")
    waiting = F.when(op.isin("send", "return"), 1).when(op == "receive", -1).otherwise(0)
    in_flight = F.when(op == "receive", 1).when(op.isin("delete", "return"), -1).otherwise(0)
    buckets = messages.groupBy("queue", truncated(bucket, "ts").alias("bucket")).agg(
        F.sum(waiting).alias("visible"), F.sum(in_flight).alias("not_visible")
    )
    return running_totals(buckets, ["queue"], "bucket", ["visible", "not_visible"])
