"""Counts over jobs and runs, and the monitoring figures built from them.

All of them reduce before they shuffle: a job or status that owns most of the runs arrives at the
exchange as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobruns.constants import (
    ACTIVE,
    DEPTH_PER_WORKER,
    FINAL_FAILED,
    NORMAL,
    PENDING_BANDS,
    QUEUES,
    RETRY,
    SCHEDULED,
    STATUSES,
    SUCCESS,
    UNSUCCESSFUL,
    WORKER_BANDS,
)
from jobruns.functions.sizing import band, clamp, workers_needed
from jobruns.functions.times import TimeLike, as_time, completed_at, seconds
from jobruns.operators.joins import zero_fill


def _number(c: Column) -> Column:
    return c.cast("double")


def table_totals(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows of the two tables, one row per table."""
    return jobs.agg(F.count("*").alias("total")).select(F.lit("jobs").alias("name"), "total").unionByName(
        tasks.agg(F.count("*").alias("total")).select(F.lit("tasks").alias("name"), "total")
    )


def runs_by_status(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(_number(F.count("*")).alias("count"))


def status_tiles(tasks: DataFrame) -> DataFrame:
    """One row with a column per status, 0 when there is none."""
    return tasks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def jobs_by_enabled_type(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.col("enabled").cast("string").alias("enabled"), "job_type").agg(
        _number(F.count("*")).alias("count")
    )


def runs_by_trigger(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("trigger_type").agg(_number(F.count("*")).alias("total"))


def runs_by_type_trigger(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs per job type and trigger. Counted per job first, so the join sees at most one row per
    job and trigger instead of every run."""
    per_job = tasks.groupBy("job_id", "trigger_type").agg(F.count("*").alias("n"))
    return (
        per_job.join(jobs.select("job_id", "job_type"), "job_id")
        .groupBy("job_type", "trigger_type")
        .agg(_number(F.sum("n")).alias("count"))
    )


def outcome_counters(tasks: DataFrame) -> DataFrame:
    """Counters that only grow: created, succeeded, failed, retried, given up."""
    return tasks.agg(
        _number(F.count("*")).alias("created_total"),
        _number(F.count_if(F.col("status") == SUCCESS)).alias("succeeded_total"),
        _number(F.count_if(F.col("status").isin(*UNSUCCESSFUL))).alias("failed_total"),
        _number(F.count_if(F.col("retry_count") > 0)).alias("retried_total"),
        _number(F.count_if(F.col("status") == FINAL_FAILED)).alias("final_failed_total"),
    )


def recent_throughput(tasks: DataFrame, now: TimeLike, window_seconds: int = 60) -> DataFrame:
    """Runs that finished after ``now`` minus the window."""
    recent = F.col("finished_at") > as_time(now) - seconds(window_seconds)
    return tasks.where(recent).agg(
        _number(F.count_if(F.col("status") == SUCCESS)).alias("success_per_min"),
        _number(F.count_if(F.col("status").isin(*UNSUCCESSFUL))).alias("failed_per_min"),
    )


def stored_queue(retry_count: Column, trigger_type: Column, job_type: Column) -> Column:
    """The queue a stored run must have been sent to."""
    return (
        F.when(retry_count > 0, RETRY)
        .when((trigger_type == SCHEDULED) & (job_type == SCHEDULED), SCHEDULED)
        .otherwise(NORMAL)
    )


def reconstruct_queue(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs of existing jobs with the queue they were sent to, as far as stored rows tell."""
    return (
        tasks.join(jobs.select("job_id", "job_type"), "job_id")
        .withColumn("queue", stored_queue(F.col("retry_count"), F.col("trigger_type"), F.col("job_type")))
        .drop("job_type")
    )


def active_by_queue(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pending and running runs per queue, all six combinations present."""
    per_job = (
        tasks.where(F.col("status").isin(*ACTIVE))
        .groupBy("job_id", "status", "trigger_type", (F.col("retry_count") > 0).cast("int").alias("retry_count"))
        .agg(F.count("*").alias("n"))
    )
    counts = (
        per_job.join(jobs.select("job_id", "job_type"), "job_id")
        .groupBy(
            stored_queue(F.col("retry_count"), F.col("trigger_type"), F.col("job_type")).alias("queue"), "status"
        )
        .agg(F.sum("n").alias("count"))
    )
    return zero_fill(counts, {"queue": list(QUEUES), "status": list(ACTIVE)})


def ready_at(upstream_runs: DataFrame, by: str = "downstream_job_id") -> DataFrame:
    """When the newest of a job's upstream runs completed."""
    return upstream_runs.groupBy(by).agg(F.max(completed_at()).alias("ready_at"))


def queue_depth_total(depths: DataFrame) -> DataFrame:
    """Waiting plus in-flight messages over all queues per sample time, with its display band."""
    depth = F.coalesce(F.col("visible"), F.lit(0)) + F.coalesce(F.col("not_visible"), F.lit(0))
    return (
        depths.groupBy("ts")
        .agg(F.sum(depth).alias("depth"))
        .withColumn("band", band(F.col("depth"), *PENDING_BANDS))
    )


def fleet_size(depths: DataFrame, per_worker: int = DEPTH_PER_WORKER, lo: int = 1, hi: int = 10) -> DataFrame:
    """Workers wanted per sample time for waiting plus in-flight work; an unreadable queue counts 0."""
    needed = workers_needed(F.col("depth"), per_worker)
    return (
        queue_depth_total(depths)
        .select("ts", "depth", needed.alias("needed"), clamp(needed, lo, hi).alias("desired"))
        .withColumn("band", band(F.col("desired"), *WORKER_BANDS, base="blue"))
    )


def queue_replicas(depths: DataFrame, per_worker: int = DEPTH_PER_WORKER, lo: int = 1, hi: int = 3) -> DataFrame:
    """Replicas wanted per queue and sample time; only waiting messages count."""
    waiting = F.sum(F.coalesce(F.col("visible"), F.lit(0)))
    return depths.groupBy("queue", "ts").agg(
        waiting.alias("visible"), clamp(workers_needed(waiting, per_worker), lo, hi).alias("replicas")
    )


def scale_action(sizes: DataFrame, desired: str = "desired", current: str = "current") -> DataFrame:
    """What to do to reach the wanted size: create or terminate some workers, or nothing."""
    gap = F.col(desired) - F.col(current)
    return sizes.withColumn(
        "action", F.when(gap > 0, "create").when(gap < 0, "terminate").otherwise("none")
    ).withColumn("amount", F.abs(gap))


def series_summary(samples: DataFrame, by: str = "series") -> DataFrame:
    """Last known value and maximum per series; of two values at one time the larger is the last."""
    known = samples.where(F.col("value").isNotNull())
    return known.groupBy(by).agg(
        F.max(F.struct("ts", "value"))["value"].alias("last"), F.max("value").alias("max")
    )


def sum_by_label(samples: DataFrame, label: str, pattern: str = ".*") -> DataFrame:
    """Sum of the values per label value, for label values that match the whole pattern."""
    return (
        samples.where(F.col(label).rlike(f"^(?:{pattern})$"))
        .groupBy(label)
        .agg(F.sum("value").alias("value"))
    )


def retry_accounting(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job: attempts, failed attempts, chains given up, and the failing attempts these must have taken."""
    per_job = tasks.groupBy("job_id").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("status").isin(*UNSUCCESSFUL)).alias("failed_attempts"),
        F.count_if(F.col("status") == FINAL_FAILED).alias("given_up"),
    )
    return per_job.join(jobs.select("job_id", "max_retries"), "job_id").select(
        "job_id",
        "attempts",
        "failed_attempts",
        "given_up",
        (F.col("given_up") * (F.col("max_retries") + 1)).alias("expected_failures"),
    )


def dispatch_accounting(jobs: DataFrame, tasks: DataFrame, runs_per_job: int = 1) -> DataFrame:
    """Per job: first attempts that should exist against those that do."""
    actual = tasks.where(F.col("retry_count") == 0).groupBy("job_id").agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return jobs.select("job_id").join(actual, "job_id", "left").select(
        "job_id",
        F.lit(runs_per_job).cast("long").alias("expected"),
        n.alias("actual"),
        (n - runs_per_job).alias("difference"),
    )


def _figure(metric: str, kind: str, keep: str = "true", only: str = "true", n: str = "n", **labels: str) -> str:
    """SQL of one figure a cell contributes its count to where ``keep`` holds, else zero; no row at
    all where ``only`` does not hold."""
    text = ", ".join(f"concat('{k}=', {v})" for k, v in sorted(labels.items())) or "''"
    row = f"""struct('{metric}' AS metric, concat_ws(',', {text}) AS labels, '{kind}' AS type,
        CASE WHEN {keep} THEN {n} ELSE 0L END AS value)"""
    return row if only == "true" else f"CASE WHEN {only} THEN {row} END"


def _inline(figures: list[str]) -> str:
    return f"inline(array({', '.join(figures)}))"


_SUCCEEDED, _FAILED = "status = 'success'", "status IN ('failed', 'final_failed')"
_STORED_QUEUE = """CASE WHEN retried THEN 'retry'
    WHEN trigger_type = 'scheduled' AND job_type = 'scheduled' THEN 'scheduled' ELSE 'normal' END"""
_RUN_FIGURES = [
    _figure("tasks_by_status_count", "gauge", status="status"),
    _figure("tasks_recent_throughput_success_per_min", "gauge", f"recent AND {_SUCCEEDED}"),
    _figure("tasks_recent_throughput_failed_per_min", "gauge", f"recent AND {_FAILED}"),
    _figure("tasks_created_total", "counter"),
    _figure("tasks_succeeded_total", "counter", _SUCCEEDED),
    _figure("tasks_failed_total", "counter", _FAILED),
    _figure("tasks_retried_total", "counter", "retried"),
    _figure("tasks_final_failed_total", "counter", "status = 'final_failed'"),
    _figure("tasks_by_trigger_total", "counter", trigger_type="trigger_type"),
    # Only for runs whose job still exists.
    _figure(
        "tasks_by_job_and_trigger_count",
        "gauge",
        only="job_type IS NOT NULL",
        job_type="job_type",
        trigger_type="trigger_type",
    ),
    _figure(
        "tasks_active_by_queue_count",
        "gauge",
        only="job_type IS NOT NULL AND status IN ('pending', 'running')",
        queue=_STORED_QUEUE,
        status="status",
    ),
]
_JOB_FIGURES = [
    _figure("jobs_total_count", "gauge"),
    _figure("jobs_by_enabled_count", "gauge", enabled="CAST(enabled AS STRING)", job_type="job_type"),
    _figure("scheduler_jobs_upcoming_count", "gauge", "armed"),
]
# Figures that are reported as 0 even over empty tables.
_ALWAYS = [
    *[
        _figure(f"tasks_recent_throughput_{c}_per_min", "gauge", n="0L")
        for c in ("success", "failed")
    ],
    *[
        _figure(f"tasks_{c}_total", "counter", n="0L")
        for c in ("created", "succeeded", "failed", "retried", "final_failed")
    ],
    *[
        _figure(m, "gauge", n="0L")
        for m in ("jobs_total_count", "scheduler_jobs_upcoming_count")
    ],
    *[
        _figure("tasks_active_by_queue_count", "gauge", n="0L", queue=f"'{q}'", status=f"'{s}'")
        for q in QUEUES
        for s in ACTIVE
    ],
]


def metrics_long(tasks: DataFrame, jobs: DataFrame, now: TimeLike, window_seconds: int = 60) -> DataFrame:
    """Every monitoring figure as ``(metric, labels, type, value)``.

    The run table is read once: runs are counted per job and distinguishing property, joined to
    their job, and reduced to a few hundred rows, from which all figures over runs are sums. The
    same goes for the jobs.
    """
    recent = F.coalesce(F.col("finished_at") > as_time(now) - seconds(window_seconds), F.lit(False))
    cells = (
        tasks.groupBy(
            "job_id", "status", "trigger_type", (F.col("retry_count") > 0).alias("retried"), recent.alias("recent")
        )
        .agg(F.count("*").alias("n"))
        .join(jobs.select("job_id", "job_type"), "job_id", "left")
        .groupBy("job_type", "status", "trigger_type", "retried", "recent")
        .agg(F.sum("n").alias("n"))
    )
    armed = F.col("enabled") & (F.col("job_type") == SCHEDULED) & (F.col("next_fire_at") >= as_time(now))
    job_cells = jobs.groupBy("enabled", "job_type", F.coalesce(armed, F.lit(False)).alias("armed")).agg(
        F.count("*").alias("n")
    )
    empty = tasks.sparkSession.range(1, numPartitions=1)
    return (
        cells.selectExpr(_inline(_RUN_FIGURES))
        .unionByName(job_cells.selectExpr(_inline(_JOB_FIGURES)))
        .unionByName(empty.selectExpr(_inline(_ALWAYS)))
        .where(F.col("metric").isNotNull())
        .groupBy("metric", "labels", "type")
        .agg(_number(F.sum("value")).alias("value"))
    )


def label_map(metrics: DataFrame) -> DataFrame:
    """``labels`` text to a map."""
    return metrics.withColumn("labels", F.when(F.col("labels") != "", F.str_to_map("labels", F.lit(","), F.lit("="))))
