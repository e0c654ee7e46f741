"""Queue messages as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobruns.constants import PENDING, SETTLED
from jobruns.functions.times import utc_wall_clock
from jobruns.sources.messages import parse_messages
from jobruns.streaming.batches import watermarked

MESSAGE_SCHEMA = "body STRING, receipt_handle STRING, queue STRING, ts TIMESTAMP_NTZ"


def read_messages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream over JSON message files; a trigger takes a bounded number of them."""
    return (
        spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def message_actions(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """What each message asks for, against the table of runs: ``run`` a pending run, ``keep`` the
    message while another worker has it, ``delete`` it when the run is finished or missing, ``drop``
    it when it carries no id. The id of a message is turned into a key of the table, not the keys into text."""
    kind = tasks.schema["task_id"].dataType.simpleString()
    known = tasks.select(F.col("task_id").alias("_key"), "status")
    status, parsed = F.col("status"), parse_messages(messages)
    key = F.col("task_id").try_cast(kind)
    # An id that only reads as the key, like 007, is none.
    exact = F.when(key.cast("string") == F.col("task_id"), key)
    return (
        parsed.withColumn("_id", exact)
        .join(known, F.col("_id") == F.col("_key"), "left")
        .drop("_id", "_key")
        .withColumn(
            "action",
            F.when(F.col("drop"), "drop")
            .when(status.isNull() | status.isin(*SETTLED), "delete")
            .when(status == PENDING, "run")
            .otherwise("keep"),
        )
        .drop("drop", "status")
    )


def dedup_messages(messages: DataFrame, horizon: str | None = None) -> DataFrame:
    """The first message of each run to arrive, on a stream. Delivery is at least once.

    Every run's id is kept in Spark's state, and no message that is its run's first is lost, however late
    its time. With ``horizon`` ids are forgotten that long after they came; then a first message that is later
    than that against the newest is dropped as well, so give one only to streams in order of time."""
    parsed = parse_messages(messages).where(~F.col("drop")).drop("drop")
    if horizon is None:
        return parsed.dropDuplicates(["task_id"])
    unique = watermarked(parsed, "ts", horizon).dropDuplicatesWithinWatermark(["task_id"])
    return unique.withColumn("ts", utc_wall_clock(F.col("ts")))
