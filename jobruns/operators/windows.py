"""Latest rows, first claims, transitions and counter arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobruns.constants import SUCCESS, UNSUCCESSFUL
from jobruns.functions.times import micros, truncated
from jobruns.operators.slices import (
    ROWS_PER_SLICE,
    assign_slices,
    borders,
    running_totals,
    trailing_sum,
    with_previous,
)


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group. Spark puts a group limit of one row in front of the exchange,
    so a hot group is cut down in the tasks that read it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def latest_run_per_job(tasks: DataFrame, job_ids: DataFrame | None = None) -> DataFrame:
    """Newest run of each job, ties broken by the larger key. Select the columns you need first."""
    if job_ids is not None:
        tasks = tasks.join(job_ids.select("job_id").distinct(), "job_id", "left_semi")
    return first_per_key(tasks, ["job_id"], F.desc("created_at"), F.desc("task_id"))


def latest_state(tasks: DataFrame, job_ids: DataFrame | None = None) -> DataFrame:
    """Newest run of each job, only what readiness needs of it.

    A plain maximum: it is reduced in the tasks that read the runs and, unlike a window, needs no
    second sort behind the exchange."""
    if job_ids is not None:
        tasks = tasks.join(job_ids.select("job_id").distinct(), "job_id", "left_semi")
    newest = F.max(F.struct("created_at", "task_id", "status", "finished_at"))
    return tasks.groupBy("job_id").agg(newest.alias("_run")).select(
        "job_id", "_run.task_id", "_run.status", "_run.created_at", "_run.finished_at"
    )


def _labels(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def counter_steps(samples: DataFrame, by: str | list[str] = "series", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Growth between neighbouring samples. After a reset the new value is the growth; the first
    sample of a series has none, and a sample without a value is none. ``by``: a label or several."""
    samples = samples.where(F.col("value").isNotNull())
    return _steps(samples, _labels(by), borders(samples, _labels(by), "ts", rows_per_slice)).drop("_slice", "_first")


def _steps(samples: DataFrame, labels: list[str], cuts: DataFrame) -> DataFrame:
    sliced = assign_slices(samples, labels, "ts", cuts=cuts)
    value, before = F.col("value"), F.col("_before")
    step = F.when(before.isNull(), F.lit(0.0)).when(value < before, value).otherwise(value - before)
    return with_previous(sliced, labels, ["ts", "value"], "value", "_before").withColumn("step", step).drop("_before")


def counter_increase(
    samples: DataFrame, window_seconds: int, by: str | list[str] = "series", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Growth of a counter in the trailing window, at every sample: the plain sum of its steps."""
    samples, labels = samples.where(F.col("value").isNotNull()), _labels(by)
    cuts = borders(samples, labels, "ts", rows_per_slice)
    return trailing_sum(_steps(samples, labels, cuts), labels, "ts", "step", window_seconds, "increase", cuts).select(
        *_labels(by), "ts", "value", "increase"
    )


def counter_rate(
    samples: DataFrame,
    window_seconds: int,
    scale: float = 1.0,
    by: str | list[str] = "series",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Growth per second, times ``scale``."""
    return counter_increase(samples, window_seconds, by, rows_per_slice).select(
        *_labels(by), "ts", "value", (F.col("increase") / window_seconds * scale).alias("rate")
    )


def status_transitions(observations: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Observations whose status differs from the one before, with seconds since the first.

    ``observations``: ``task_id, ts, seq, status``; ``seq`` orders observations of one time."""
    sliced = assign_slices(observations, ["task_id"], "ts", rows_per_slice)
    at = micros(F.col("ts"))
    order = Window.partitionBy("task_id", "_slice").orderBy("ts", "seq")
    changed = (
        with_previous(sliced, ["task_id"], ["ts", "seq"], "status", "previous")
        .withColumn("_first", F.coalesce("_first", F.first(at).over(order)))
        .where(~F.col("status").eqNullSafe(F.col("previous")))
    )
    return changed.select(
        "task_id", "ts", "seq", "status", "previous", ((at - F.col("_first")) / 1_000_000).alias("elapsed_s")
    )


def cumulative_counts(tasks: DataFrame, bucket: str = "minute") -> DataFrame:
    """Created, succeeded and failed runs up to each bucket of time in which something happened."""
    created = F.struct(
        F.col("created_at").alias("ts"),
        F.lit(1).alias("created"),
        F.lit(0).alias("succeeded"),
        F.lit(0).alias("failed"),
    )
    finished = F.struct(
        F.col("finished_at").alias("ts"),
        F.lit(0).alias("created"),
        (F.col("status") == SUCCESS).cast("int").alias("succeeded"),
        F.col("status").isin(*UNSUCCESSFUL).cast("int").alias("failed"),
    )
    counts = ["created", "succeeded", "failed"]
    buckets = (
        tasks.select(F.inline(F.array(created, finished)))
        .where(F.col("ts").isNotNull())
        .groupBy(truncated(bucket, "ts").alias("bucket"))
        .agg(*[F.sum(c).alias(c) for c in counts])
    )
    return running_totals(buckets, [], "bucket", counts)


def first_claim_per_task(attempts: DataFrame) -> DataFrame:
    """One winner per task: the earliest attempt, then the smaller worker id, then ``seq``."""
    first = F.min(F.struct("attempted_at", "worker_id", "seq"))
    return attempts.groupBy("task_id").agg(first.alias("_first")).select(
        "task_id", "_first.worker_id", "_first.seq", "_first.attempted_at"
    )


def latest_version_per_job(changes: DataFrame) -> DataFrame:
    """The last change of each job in a change feed; of changes at one time the one whose content sorts last."""
    return first_per_key(changes, ["job_id"], F.desc("updated_at"), F.desc(F.to_json(F.struct("*"))))
