"""Cron calendars, dispatch of cron and one-time jobs, and the scheduler's snapshot."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobruns.constants import (
    INVALID_CRON,
    JOB_NOT_FOUND,
    MANUAL,
    NORMAL,
    PENDING,
    RETRY,
    RUNNING,
    SCHEDULED,
    SYNC_OVERLAP_SECONDS,
)
from jobruns.functions import cron
from jobruns.functions.text import blank_to_null, run_key
from jobruns.functions.times import TimeLike, as_time, same_firing, seconds
from jobruns.operators.joins import jobs_without_upstream
from jobruns.operators.select import changed_since, due_jobs
from jobruns.operators.windows import latest_version_per_job


class Dispatch(NamedTuple):
    """Rows to append to the runs, and job rows that changed."""

    new_runs: DataFrame
    changed_jobs: DataFrame


class Verdict(NamedTuple):
    """Rows to append to the runs, and the requests that were refused with their reason."""

    new_runs: DataFrame
    refused: DataFrame


def route(origin: Column) -> Column:
    """The queue of a run at its creation. ``origin``: manual, dependency, scheduled or retry."""
    return F.when(origin == SCHEDULED, SCHEDULED).when(origin == RETRY, RETRY).otherwise(NORMAL)


def route_runs(new_runs: DataFrame) -> DataFrame:
    """Add ``queue`` to freshly created runs: a run with a retry count was created by a retry."""
    return new_runs.withColumn(
        "queue", route(F.when(F.col("retry_count") > 0, RETRY).otherwise(F.col("trigger_type")))
    )


def new_runs(df: DataFrame, trigger: str | Column, now: TimeLike, retry_count: Column | None = None, *key: Column) -> DataFrame:
    """One pending run per row of ``df``. Its id follows from job, trigger, time and ``key``."""
    trigger = trigger if isinstance(trigger, Column) else F.lit(trigger)
    retries = F.lit(0) if retry_count is None else retry_count
    runs = df.select(
        run_key(F.col("job_id"), trigger, as_time(now), retries, *key).alias("task_id"),
        "job_id",
        F.lit(PENDING).alias("status"),
        trigger.alias("trigger_type"),
        retries.cast("int").alias("retry_count"),
        as_time(now).alias("created_at"),
        F.lit(False).alias("processed_for_chaining"),
    )
    return route_runs(runs)


# Calendars


def _expressions(jobs: DataFrame) -> DataFrame:
    """Distinct expressions with their parsed fields: the cron work is done once per expression."""
    return (
        jobs.select("cron_expression")
        .where(F.col("cron_expression").isNotNull())
        .distinct()
        .withColumn("fields", cron.cron_fields("cron_expression"))
    )


def check_cron(jobs: DataFrame) -> DataFrame:
    """``jobs`` with ``cron_ok``: is the expression acceptable? False without one."""
    # Counted rather than filtered: a condition on the expression would be moved below the distinct.
    checked = (
        jobs.select("cron_expression")
        .where(F.col("cron_expression").isNotNull())
        .distinct()
        .groupBy("cron_expression")
        .agg((F.count_if(cron.valid_cron("cron_expression")) > 0).alias("cron_ok"))
    )
    return jobs.join(checked, "cron_expression", "left").withColumn(
        "cron_ok", F.coalesce("cron_ok", F.lit(False))
    )


def next_fire(jobs: DataFrame, base: TimeLike) -> DataFrame:
    """``jobs`` with ``fires_at``: the first firing strictly after ``base``; null without a cron
    expression, with an invalid one, or with one that never matches a date."""
    times = (
        _expressions(jobs)
        .withColumn("base", as_time(base))
        .select("cron_expression", cron.next_after("fields", "base").alias("fires_at"))
    )
    return jobs.join(times, "cron_expression", "left")


def settled(jobs: DataFrame, now: TimeLike) -> DataFrame:
    """``cron_expression, valid, next_fire_at`` of the different expressions of ``jobs``, blanks around them left out."""
    trimmed = jobs.select(blank_to_null(F.col("cron_expression")).alias("cron_expression"))
    return (
        _expressions(trimmed)
        .withColumn("base", as_time(now))
        .select("cron_expression", F.col("fields").isNotNull().alias("valid"), cron.next_after("fields", "base").alias("next_fire_at"))
    )


def classify_schedule(jobs: DataFrame, now: TimeLike, expressions: DataFrame | None = None) -> DataFrame:
    """``job_id, job_type, cron_expression, next_fire_at, error`` from the raw expression. ``expressions``: those of
    :func:`settled`, if they are worked out already."""
    trimmed = jobs.select("job_id", blank_to_null(F.col("cron_expression")).alias("cron_expression"))
    times = settled(jobs, now) if expressions is None else expressions
    invalid = F.col("cron_expression").isNotNull() & ~F.col("valid")
    return trimmed.join(times, "cron_expression", "left").select(
        "job_id",
        F.when(F.col("cron_expression").isNull(), NORMAL).when(~invalid, SCHEDULED).alias("job_type"),
        "cron_expression",
        "next_fire_at",
        F.when(invalid, INVALID_CRON).alias("error"),
    )


def _calendar(jobs: DataFrame, start: Column, end: Column) -> DataFrame:
    """``cron_expression, days, minutes``: the matching days of an interval, and the minutes at which such a day fires."""
    return (
        _expressions(jobs)
        .withColumns({"first": F.to_date(start), "last": F.to_date(end)})
        .select(
            "cron_expression",
            cron.days_between("fields", "first", "last").alias("days"),
            cron.minutes_of_day("fields").alias("minutes"),
        )
    )


def fire_calendar(jobs: DataFrame, start: TimeLike, end: TimeLike) -> DataFrame:
    """Every firing after ``start`` up to ``end``: ``job_id, fire_at``.

    Days and minutes are worked out per distinct expression; a job row unfolds them locally, so an
    expression shared by a third of the jobs costs no exchange of its firings."""
    start, end = as_time(start), as_time(end)
    # explode_outer: a plain explode makes Spark test the arrays for being empty, and it does so
    # below the distinct, once per job. The nulls fall to the last condition.
    return (
        jobs.select("job_id", "cron_expression")
        .join(_calendar(jobs, start, end), "cron_expression")
        .select("job_id", "minutes", F.explode_outer("days").alias("day"))
        .select("job_id", "day", F.explode_outer("minutes").alias("minute"))
        .select("job_id", cron.at_minute("day", "minute").alias("fire_at"))
        .where((F.col("fire_at") > start) & (F.col("fire_at") <= end))
    )


def missed_firings(jobs: DataFrame, tasks: DataFrame, start: TimeLike, end: TimeLike) -> DataFrame:
    """Every planned firing in an interval with the run that it started: ``job_id, fire_at, task_id``, null where it was missed.

    A scheduled first attempt belongs to the last firing before it, so runs and firings keep their order, and a run
    too many stands for no firing but its own; of several runs of one firing the first counts. A run's firing is read from its
    job's calendar, and what is exchanged is runs and days: a day's firings are unfolded last, beside the runs of that day."""
    start, end = as_time(start), as_time(end)
    calendar = _calendar(jobs, start, end)
    planned = jobs.select("job_id", "cron_expression").where(F.col("cron_expression").isNotNull())
    started = tasks.where(
        (F.col("trigger_type") == SCHEDULED) & (F.col("retry_count") == 0) & (F.col("created_at") > start) & (F.col("created_at") <= end)
    ).select("job_id", F.col("created_at").alias("at"), "task_id")
    met = (
        started.join(planned, "job_id")
        .join(calendar, "cron_expression")
        .select("job_id", "at", "task_id", cron.last_before("days", "minutes", "at").alias("fire_at"))
        .where(F.col("fire_at") > start)
        .groupBy("job_id", "fire_at")
        .agg(F.min(F.struct("at", "task_id"))["task_id"].alias("task_id"))
        .groupBy("job_id", F.to_date("fire_at").alias("day"))
        .agg(F.map_from_entries(F.collect_list(F.struct("fire_at", "task_id"))).alias("met"))
    )
    return (
        planned.join(calendar.select("cron_expression", "days"), "cron_expression")
        .select("job_id", "cron_expression", F.explode_outer("days").alias("day"))
        .join(met, ["job_id", "day"], "left")
        .join(calendar.select("cron_expression", "minutes"), "cron_expression")
        .select("job_id", "day", "met", F.explode_outer("minutes").alias("minute"))
        .select("job_id", cron.at_minute("day", "minute").alias("fire_at"), "met")
        .where((F.col("fire_at") > start) & (F.col("fire_at") <= end))
        .select("job_id", "fire_at", F.try_element_at("met", "fire_at").alias("task_id"))
    )


def dispatch_audit(jobs: DataFrame, tasks: DataFrame, start: TimeLike, end: TimeLike) -> DataFrame:
    """Per cron job: planned firings against scheduled first attempts created in the same interval."""
    start, end = as_time(start), as_time(end)
    planned = (
        _expressions(jobs)
        .withColumns({"t0": start, "t1": end, "first": F.to_date(start), "last": F.to_date(end)})
        .select("*", cron.days_between("fields", "first", "last").alias("days"), cron.minutes_of_day("fields").alias("minutes"))
        .select("cron_expression", F.coalesce(cron.count_firings(), F.lit(0)).cast("long").alias("planned"))
    )
    actual = (
        tasks.where(
            (F.col("trigger_type") == SCHEDULED)
            & (F.col("retry_count") == 0)
            & (F.col("created_at") > start)
            & (F.col("created_at") <= end)
        )
        .groupBy("job_id")
        .agg(F.count("*").alias("actual"))
    )
    return (
        jobs.select("job_id", "cron_expression")
        .join(planned, "cron_expression")
        .join(actual, "job_id", "left")
        .select("job_id", "planned", F.coalesce("actual", F.lit(0)).alias("actual"))
    )


# Dispatch


def concurrency_gate(due: DataFrame, tasks: DataFrame) -> DataFrame:
    """``due`` with ``blocked``. Only the policy ``forbid`` blocks, and only while a run of the job
    is running; pending runs do not count and ``replace`` acts like ``allow``."""
    busy = (
        tasks.where(F.col("status") == RUNNING)
        .select("job_id")
        .distinct()
        .withColumn("_busy", F.lit(True))
    )
    forbids = F.coalesce(F.col("concurrency_policy") == "forbid", F.lit(False))
    return (
        due.join(busy, "job_id", "left")
        .withColumn("blocked", forbids & F.col("_busy").isNotNull())
        .drop("_busy")
    )


def dispatch_due(jobs: DataFrame, tasks: DataFrame, now: TimeLike) -> Dispatch:
    """Fire the due cron jobs. Missed firings collapse into one, and a blocked job still moves on."""
    gated = concurrency_gate(due_jobs(jobs, now), tasks)
    changed = next_fire(due_jobs(jobs, now), now).withColumn("next_fire_at", F.col("fires_at"))
    return Dispatch(
        new_runs(gated.where(~F.col("blocked")), SCHEDULED, now),
        changed.select(*jobs.columns),
    )


def dispatch_one_time(jobs: DataFrame, edges: DataFrame, now: TimeLike) -> DataFrame:
    """A run for each enabled one-time job that waits for no upstream."""
    ready = jobs.where((F.col("job_type") == NORMAL) & F.col("enabled"))
    return new_runs(jobs_without_upstream(ready.select("job_id"), edges), MANUAL, now)


def dispatch_on_enable(before: DataFrame, after: DataFrame, edges: DataFrame, now: TimeLike) -> DataFrame:
    """One-time jobs that were switched on between the two versions of the job table."""
    was_off = before.where(~F.col("enabled")).select("job_id")
    switched = after.where(F.col("enabled")).join(was_off, "job_id", "left_semi")
    return dispatch_one_time(switched, edges, now)


def each_request(requests: DataFrame, on: str) -> tuple[DataFrame, list[Column]]:
    """The requests to serve, and what tells two for the same thing apart: their ``request_id``; without
    that column equal requests are one."""
    if "request_id" in requests.columns:
        return requests, [F.col("request_id")]
    return requests.select(on).distinct(), []


def trigger(requests: DataFrame, jobs: DataFrame, now: TimeLike) -> Verdict:
    """A manual run per requested job; whether it is enabled, its policy and its upstreams do not
    matter. ``requests``: ``job_id`` and, if a job may be asked for twice, ``request_id``."""
    requests, key = each_request(requests, "job_id")
    known = jobs.select("job_id")
    return Verdict(
        new_runs(requests.join(known, "job_id", "left_semi"), MANUAL, now, None, *key),
        requests.join(known, "job_id", "left_anti").withColumn("reason", F.lit(JOB_NOT_FOUND)),
    )


# Snapshot of the cron jobs


def next_cursor(started_at: TimeLike) -> Column:
    """Where the next sync starts reading: a little before this one, so that nothing is missed."""
    return as_time(started_at) - seconds(SYNC_OVERLAP_SECONDS)


def sync_snapshot(snapshot: DataFrame, changes: DataFrame, cursor: TimeLike | None = None) -> DataFrame:
    """The snapshot after the changes since ``cursor``: disabled jobs leave, others are replaced by
    their last version. Applying the same changes again alters nothing."""
    latest = latest_version_per_job(changed_since(changes, cursor))
    kept = snapshot.join(latest.select("job_id"), "job_id", "left_anti")
    return kept.unionByName(latest.where(F.col("enabled")).select(*snapshot.columns))


def live_firings(planned: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``planned`` (``job_id, fire_at``) with ``live``: the job is still there and still fires then."""
    current = snapshot.select("job_id", F.col("next_fire_at").alias("_current"))
    return (
        planned.join(current, "job_id", "left")
        .withColumn("live", F.coalesce(same_firing(F.col("_current"), F.col("fire_at")), F.lit(False)))
        .drop("_current")
    )


def new_plans(snapshot: DataFrame, latest: DataFrame) -> DataFrame:
    """Firings of the latest versions that the snapshot does not plan already."""
    known = snapshot.select("job_id", F.col("next_fire_at").alias("_known"))
    moved = ~F.coalesce(same_firing(F.col("_known"), F.col("next_fire_at")), F.lit(False))
    return (
        latest.where(F.col("enabled") & F.col("next_fire_at").isNotNull())
        .join(known, "job_id", "left")
        .where(moved)
        .select("job_id", F.col("next_fire_at").alias("fire_at"))
    )
