"""Filters, paging and ordered selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobruns.constants import ACTIVE, PENDING, RUNNING, SCHEDULED, SETTLED, SUCCESS
from jobruns.functions.sizing import pages
from jobruns.functions.text import name_contains
from jobruns.functions.times import TimeLike, as_time, micros


def filter_jobs(
    jobs: DataFrame,
    enabled: bool | None = None,
    action_type: str | None = None,
    concurrency_policy: str | None = None,
    q: str | None = None,
) -> DataFrame:
    """All given predicates together; ``None`` (and an empty search) asks for nothing."""
    if enabled is not None:
        jobs = jobs.where(F.col("enabled") == enabled)
    if action_type is not None:
        jobs = jobs.where(F.col("action_type") == action_type)
    if concurrency_policy is not None:
        jobs = jobs.where(F.col("concurrency_policy") == concurrency_policy)
    if q:
        jobs = jobs.where(name_contains(F.col("name"), q))
    return jobs


def newest_first(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc(key))


#: Rows that a task may keep to find a page, and parts into which a span of time is cut to find where it begins.
NEAR, PARTS = 10_000, 1024


def page(df: DataFrame, page: int = 1, page_size: int = 20, key: str = "job_id") -> DataFrame:
    """One page, newest first, rows without a time last. No table is sorted: Spark keeps the rows up to the page's end from each
    partition, at most ``NEAR`` and a page; for a page further on, the time from which so many rows are left to skip is looked up
    by counting, and newer rows are passed over. (Rows of one and the same time are kept all.)"""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page starts at 1, page_size is 1 to 100")
    offset = (page - 1) * page_size
    if offset > NEAR:
        until, newer = _time_before(df, offset)
        df = df.where(F.col("created_at").isNull() | (micros(F.col("created_at")) <= until))
        offset -= newer
    return newest_first(df, key).offset(offset).limit(page_size)


def _time_before(df: DataFrame, offset: int) -> tuple[int, int]:
    """A time, and the number of rows newer than it: at most ``offset``, and less by no more than ``NEAR`` unless so many rows
    have that time. Each step counts the rows of the part of the last step in which the offset lies."""
    at = micros(F.col("created_at"))
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    if lo is None:
        return 0, 0
    newer = 0
    while True:
        width = (hi - lo) // PARTS + 1
        part = F.floor((F.lit(hi) - at) / F.lit(width))
        counts = dict(df.where(at.between(lo, hi)).groupBy(part.alias("part")).count().collect())
        for i in range(PARTS):
            if newer + counts.get(i, 0) > offset:
                break
            newer += counts.get(i, 0)
        else:
            return lo - 1, newer
        lo, hi = max(lo, hi - (i + 1) * width + 1), hi - i * width
        if offset - newer <= NEAR or lo == hi:
            return hi, newer


def page_envelope(df: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One row of totals for the filtered set, with the first and last item shown on the page."""
    before = (page - 1) * page_size
    total = F.col("total")
    shown = F.greatest(F.least(total - before, F.lit(page_size)), F.lit(0))
    return df.agg(F.count("*").alias("total")).select(
        F.lit(page).cast("long").alias("page"),
        F.lit(page_size).cast("long").alias("page_size"),
        total,
        pages(total, page_size).alias("total_pages"),
        F.when(total == 0, 0).otherwise(before + 1).cast("long").alias("first_item"),
        F.when(total == 0, 0).otherwise(before + shown).cast("long").alias("last_item"),
    )


def runs_of_job(tasks: DataFrame, job_id) -> DataFrame:
    """Every run of one job, newest first."""
    return newest_first(tasks.where(F.col("job_id") == F.lit(job_id)), "task_id")


def running_per_job(tasks: DataFrame) -> DataFrame:
    """Running (not pending) runs per job."""
    return tasks.where(F.col("status") == RUNNING).groupBy("job_id").agg(F.count("*").alias("running"))


def expired_running(tasks: DataFrame, now: TimeLike) -> DataFrame:
    """Running with a lock that ended before ``now``; ending exactly at ``now`` is not expired."""
    return tasks.where((F.col("status") == RUNNING) & (F.col("locked_until") < as_time(now)))


def unchained_successes(tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """Successful runs whose dependents were not looked at yet.

    With ``limit`` the oldest that many, in order; without it all of them, unordered, for
    set-at-a-time processing."""
    waiting = tasks.where((F.col("status") == SUCCESS) & ~F.col("processed_for_chaining"))
    return waiting if limit is None else waiting.orderBy("created_at", "task_id").limit(limit)


def changed_since(jobs: DataFrame, since: TimeLike | None = None) -> DataFrame:
    """Cron jobs changed at or after ``since``, disabled ones included so that they can be evicted."""
    cron = jobs.where(F.col("job_type") == SCHEDULED)
    return cron if since is None else cron.where(F.col("updated_at") >= as_time(since))


def due_jobs(jobs: DataFrame, now: TimeLike) -> DataFrame:
    """Enabled cron jobs to fire at ``now``, the ones due exactly then included."""
    return jobs.where(
        F.col("enabled") & (F.col("job_type") == SCHEDULED) & (F.col("next_fire_at") <= as_time(now))
    )


def in_due_order(df: DataFrame) -> DataFrame:
    return df.orderBy("next_fire_at", "job_id")


def armed_jobs(jobs: DataFrame, now: TimeLike) -> DataFrame:
    """How many enabled cron jobs have their firing at or after ``now``."""
    return jobs.where(
        F.col("enabled") & (F.col("job_type") == SCHEDULED) & (F.col("next_fire_at") >= as_time(now))
    ).agg(F.count("*").cast("double").alias("armed"))


def jobs_by_ids(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs whose id occurs in ``ids`` (column ``job_id``); unknown ids are ignored."""
    return jobs.join(ids.select("job_id"), "job_id", "left_semi")


def active_runs(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status").isin(*ACTIVE))


def settled_runs(tasks: DataFrame) -> DataFrame:
    """Runs that will not change any more; a failed attempt is settled, its retry is another row."""
    return tasks.where(F.col("status").isin(*SETTLED))


def dependency_candidates(
    jobs: DataFrame, job_id, selected: DataFrame, q: str | None = None, size: int = 50
) -> DataFrame:
    """Jobs offered as dependencies: first page of the search, without the job itself and those
    already selected, by name."""
    first = page(filter_jobs(jobs, q=q), 1, size)
    return (
        first.where(F.col("job_id") != F.lit(job_id))
        .join(selected.select("job_id"), "job_id", "left_anti")
        .orderBy("name", "job_id")
    )


def pending_of_queue(routed: DataFrame, queue: str) -> DataFrame:
    """What the worker pool of one queue may take."""
    return routed.where((F.col("queue") == queue) & (F.col("status") == PENDING))


def scale_down_victims(workers: DataFrame, n: int) -> DataFrame:
    """The ``n`` oldest autoscaled workers; an unknown creation time counts as oldest and a
    baseline worker is never chosen."""
    return (
        workers.where(F.col("autoscaled"))
        .orderBy(F.coalesce(F.col("created").cast("string"), F.lit("")), "name")
        .limit(max(n, 0))
    )
