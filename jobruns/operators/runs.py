"""Claims, leases, outcomes, retries, and dispatch along the dependency graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobruns.constants import (
    DEPENDENCY,
    FAILED,
    FINAL_FAILED,
    JOB_NOT_FOUND,
    LEASE_SECONDS,
    NOT_RETRYABLE,
    OUTPUT_CAP,
    PENDING,
    RUNNING,
    SETTLED,
    SUCCESS,
    TASK_NOT_FOUND,
    UNSUCCESSFUL,
)
from jobruns.functions.text import decode_text, truncate_output
from jobruns.functions.times import TimeLike, as_time, completed_at, seconds
from jobruns.operators.graph import DOWN, UP, candidate_set, candidates
from jobruns.operators.joins import upstream_state
from jobruns.operators.schedule import Verdict, each_request, new_runs
from jobruns.operators.select import expired_running, unchained_successes
from jobruns.operators.windows import first_claim_per_task, latest_state


def _null(kind: str):
    return F.lit(None).cast(kind)


class Outcome(NamedTuple):
    """Finished run rows, and the retries they cause."""

    finished: DataFrame
    retries: DataFrame


class Chained(NamedTuple):
    """Runs of dependent jobs, and the successful runs that were looked at."""

    new_runs: DataFrame
    marked: DataFrame


# Claims and leases


def _pending_winners(attempts: DataFrame, tasks: DataFrame) -> DataFrame:
    """The first attempt on each pending run."""
    pending = tasks.where(F.col("status") == PENDING).select("task_id")
    return first_claim_per_task(attempts).join(pending, "task_id", "left_semi")


def claim(attempts: DataFrame, tasks: DataFrame, now: TimeLike, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """The claimed runs: one winner per pending run, set running under a lease."""
    winners = _pending_winners(attempts, tasks).select("task_id", F.col("worker_id").alias("_winner"))
    changed = {
        "status": F.lit(RUNNING),
        "locked_by": F.col("_winner"),
        "locked_until": as_time(now) + seconds(lease_seconds),
        "started_at": as_time(now),
    }
    return tasks.join(winners, "task_id").withColumns(changed).select(*tasks.columns)


def claim_loss_action(attempts: DataFrame, tasks: DataFrame) -> DataFrame:
    """What happens to the message of each attempt that got no run: ``delete`` when nobody will need
    it any more (run missing or finished), else ``keep``."""
    key = ["task_id", "attempted_at", "worker_id", "seq"]
    losers = attempts.join(_pending_winners(attempts, tasks).select(*key), key, "left_anti")
    status = F.col("status")
    return losers.join(tasks.select("task_id", "status"), "task_id", "left").select(
        *attempts.columns,
        F.when(status.isNull() | status.isin(*SETTLED), "delete").otherwise("keep").alias("action"),
    )


def heartbeat_interval(lease_seconds: int = LEASE_SECONDS) -> int:
    """Seconds between two beats: 0.6 of the lease, at least one."""
    return max(1, lease_seconds * 6 // 10)


def lease_extension(heartbeats: DataFrame, tasks: DataFrame, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """``task_id, locked_by, locked_until`` after the beats of the workers that own the locks."""
    last = heartbeats.groupBy("task_id", F.col("worker_id").alias("locked_by")).agg(F.max("ts").alias("beat"))
    return tasks.select("task_id", "locked_by").join(last, ["task_id", "locked_by"]).select(
        "task_id", "locked_by", (F.col("beat") + seconds(lease_seconds)).alias("locked_until")
    )


def recover_orphans(tasks: DataFrame, now: TimeLike) -> DataFrame:
    """Runs whose lease has ended, back to pending. No message is sent and no retry is counted."""
    return expired_running(tasks, now).withColumns(
        {
            "status": F.lit(PENDING),
            "locked_by": _null("string"),
            "locked_until": _null("timestamp_ntz"),
            "started_at": _null("timestamp_ntz"),
        }
    )


# Outcomes


def apply_results(
    results: DataFrame, tasks: DataFrame, jobs: DataFrame, now: TimeLike, cap: int = OUTPUT_CAP
) -> Outcome:
    """Outcome of executed runs, ``results``: ``task_id, success, stdout, stderr``; outputs as text or as
    the bytes that were captured.

    A failure retries until the job's ``max_retries`` are used up, so a job takes at most
    ``max_retries + 1`` attempts. A run whose job is gone gives up at once."""
    for output in ("stdout", "stderr"):
        if dict(results.dtypes)[output] == "binary":
            results = results.withColumn(output, decode_text(F.col(output)))
    known = tasks.select("task_id", "job_id", "trigger_type", "retry_count").join(results, "task_id")
    limits = jobs.select("job_id", F.col("max_retries").alias("_limit"))
    judged = known.join(limits, "job_id", "left")
    gone = F.col("_limit").isNull()
    judged = judged.withColumn(
        "status",
        F.when(gone, FINAL_FAILED)
        .when(F.col("success"), SUCCESS)
        .when(F.col("retry_count") >= F.col("_limit"), FINAL_FAILED)
        .otherwise(FAILED),
    )
    finished = judged.select(
        "task_id",
        "job_id",
        "status",
        F.when(gone, "").otherwise(truncate_output(F.col("stdout"), cap)).alias("stdout"),
        F.when(gone, JOB_NOT_FOUND).otherwise(truncate_output(F.col("stderr"), cap)).alias("stderr"),
        _null("string").alias("locked_by"),
        _null("timestamp_ntz").alias("locked_until"),
        as_time(now).alias("finished_at"),
    )
    again = judged.where(F.col("status") == FAILED).select("task_id", "job_id", "trigger_type", "retry_count")
    return Outcome(finished, retry_runs(again, now))


def retry_runs(failed: DataFrame, now: TimeLike, *key: Column) -> DataFrame:
    """The next attempt of each given run; the run it repeats is part of its id."""
    return new_runs(failed, F.col("trigger_type"), now, F.col("retry_count") + 1, F.col("task_id"), *key)


def manual_retry(requests: DataFrame, tasks: DataFrame, now: TimeLike) -> Verdict:
    """A new attempt of each requested run that failed; ``max_retries`` does not limit it.

    ``requests``: ``task_id`` and, if a run may be asked for twice, ``request_id``."""
    asked, key = each_request(requests, "task_id")
    found = asked.join(tasks.select("task_id", "job_id", "status", "trigger_type", "retry_count"), "task_id", "left")
    failed = F.col("status").isin(*UNSUCCESSFUL)
    refused = found.where(F.col("status").isNull() | ~failed).select(
        "task_id",
        F.when(F.col("status").isNull(), TASK_NOT_FOUND).otherwise(NOT_RETRYABLE).alias("reason"),
    )
    return Verdict(retry_runs(found.where(failed), now, *key), refused)


# Dependencies


def ready_jobs(candidate_jobs: DataFrame, edges: DataFrame, latest: DataFrame) -> DataFrame:
    """Candidates with at least one upstream whose upstreams all succeeded last, with ``ready_at``."""
    wanted = edges.join(candidate_jobs.select(F.col("job_id").alias(DOWN)), DOWN, "left_semi")
    good = F.coalesce(F.col("status") == SUCCESS, F.lit(False))
    return (
        upstream_state(wanted, latest)
        .groupBy(F.col(DOWN).alias("job_id"))
        .agg(F.bool_and(good).alias("_all"), F.max("completed_at").alias("ready_at"))
        .where("_all")
        .select("job_id", "ready_at")
    )


def generation_guard(ready: DataFrame, latest: DataFrame) -> DataFrame:
    """Drop jobs that already ran after their newest upstream completion."""
    own = latest.select("job_id", completed_at().alias("_own"))
    return (
        ready.join(own, "job_id", "left")
        .where(F.col("_own").isNull() | (F.col("_own") < F.col("ready_at")))
        .select("job_id", "ready_at")
    )


def ready_now(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Every job that could run now, judged by all downstream jobs of the graph."""
    latest = latest_state(tasks)
    downstream = edges.select(F.col(DOWN).alias("job_id"))
    return generation_guard(ready_jobs(downstream, edges, latest), latest)


def dispatch_dependents(
    tasks: DataFrame, jobs: DataFrame, edges: DataFrame, now: TimeLike, limit: int | None = None
) -> Chained:
    """One pending run for each enabled job made ready by successes not looked at before.

    One level per call. Successes that lead to nothing are marked too. ``limit`` takes only the
    oldest successes and leaves the rest for the next call; by default all are taken."""
    successes = unchained_successes(tasks, limit)
    latest = latest_state(tasks, candidate_set(successes, edges, jobs))
    ready = ready_jobs(candidates(successes, edges, jobs), edges, latest)
    return Chained(
        new_runs(generation_guard(ready, latest), DEPENDENCY, now),
        successes.withColumn("processed_for_chaining", F.lit(True)),
    )


def blocked_report(candidate_jobs: DataFrame, edges: DataFrame, latest: DataFrame) -> DataFrame:
    """Every upstream that holds a candidate back, with its status or ``never run``."""
    wanted = edges.join(candidate_jobs.select(F.col("job_id").alias(DOWN)), DOWN, "left_semi")
    return (
        upstream_state(wanted, latest)
        .where(F.col("status").isNull() | (F.col("status") != SUCCESS))
        .select(DOWN, UP, F.coalesce("status", F.lit("never run")).alias("upstream_status"))
    )
