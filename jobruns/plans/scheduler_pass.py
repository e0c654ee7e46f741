"""One pass of the scheduler over whole tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobruns.constants import PENDING, RUNNING
from jobruns.functions.times import TimeLike, as_time
from jobruns.operators.runs import dispatch_dependents, recover_orphans
from jobruns.operators.schedule import dispatch_due
from jobruns.sources.tables import Tables


class Pass(NamedTuple):
    """What the caller has to write: runs to append, and rows that replace rows of the same key."""

    new_runs: DataFrame
    changed_tasks: DataFrame
    changed_jobs: DataFrame


def scheduler_pass(tables: Tables, now: TimeLike) -> Pass:
    """Orphans, then due jobs, then dependents, all at one ``now``. The job table is read as it is,
    so there is no snapshot to bring up to date first."""
    now = as_time(now)
    expired = (F.col("status") == RUNNING) & (F.col("locked_until") < now)
    light = tables.tasks.select(
        F.col("task_id").cast("string").alias("task_id"),
        "job_id",
        F.when(expired, PENDING).otherwise(F.col("status")).alias("status"),
        "created_at",
        "finished_at",
        "processed_for_chaining",
    )
    due = dispatch_due(tables.jobs, light, now)
    fresh = due.new_runs.select(
        "task_id",
        "job_id",
        "status",
        "created_at",
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        "processed_for_chaining",
    )
    chained = dispatch_dependents(light.unionByName(fresh), tables.jobs, tables.edges, now)
    unseen = (F.col("status") == "success") & ~F.col("processed_for_chaining")
    marked = tables.tasks.where(unseen).withColumn("processed_for_chaining", F.lit(True))
    return Pass(
        due.new_runs.unionByName(chained.new_runs),
        recover_orphans(tables.tasks, now).unionByName(marked),
        due.changed_jobs,
    )
