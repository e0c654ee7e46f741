"""Runs, leases and job changes as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobruns.constants import DEPENDENCY, LEASE_SECONDS, SUCCESS, UNSUCCESSFUL
from jobruns.functions.times import TimeLike, as_instant, seconds, utc_wall_clock
from jobruns.operators.graph import candidate_set, candidates
from jobruns.operators.runs import generation_guard, ready_jobs
from jobruns.operators.schedule import new_runs
from jobruns.operators.select import changed_since
from jobruns.operators.windows import latest_state, status_transitions
from jobruns.sources.tables import Tables, append_tasks
from jobruns.streaming.batches import newest, read_batches, start, start_newest, start_per_key, watermarked, write_batch

SNAPSHOT_COLUMNS = ("job_id", "job_type", "enabled", "next_fire_at", "updated_at")


def throughput(
    finished: DataFrame, width: str = "1 minute", slide: str | None = None, delay: str = "1 minute"
) -> DataFrame:
    """Successful and failed runs per window of their finish; sliding when ``slide`` is given."""
    status = F.col("status")
    at = F.window("finished_at", width, slide) if slide else F.window("finished_at", width)
    return (
        watermarked(finished.where(F.col("finished_at").isNotNull()), "finished_at", delay)
        .groupBy(at.alias("w"))
        .agg(
            F.count_if(status == SUCCESS).alias("success"),
            F.count_if(status.isin(*UNSUCCESSFUL)).alias("failed"),
        )
        .select(
            utc_wall_clock(F.col("w.start")).alias("window_start"),
            utc_wall_clock(F.col("w.end")).alias("window_end"),
            "success",
            "failed",
        )
    )


def throughput_sliding(finished: DataFrame, width: str = "1 minute", slide: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """Successful and failed runs per sliding window, put together from panes one slide wide: a run is counted in one pane, and only
    panes are dealt to all the windows that hold them. In append mode a window comes out when the watermark has passed it."""
    status = F.col("status")
    panes = (
        watermarked(finished.where(F.col("finished_at").isNotNull()), "finished_at", delay)
        .groupBy(F.window("finished_at", slide).alias("pane"))
        .agg(F.count_if(status == SUCCESS).alias("success"), F.count_if(status.isin(*UNSUCCESSFUL)).alias("failed"))
    )
    return (
        panes.groupBy(F.window(F.window_time("pane"), width, slide).alias("w"))
        .agg(F.sum("success").alias("success"), F.sum("failed").alias("failed"))
        .where("success + failed > 0")
        .select(utc_wall_clock(F.col("w.start")).alias("window_start"), utc_wall_clock(F.col("w.end")).alias("window_end"), "success", "failed")
    )


def leases(events: DataFrame, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """Leases that ended, or will end, without the run finishing: ``task_id, worker_id, locked_until``.

    ``events``: ``task_id, worker_id, ts, kind`` with kind claim, beat or finish. A claim opens a
    lease, beats of the same worker keep it open, so a lease is a session of these events with the
    lease as its gap. A session without a claim is a worker that has lost its run; one whose last
    claim was finished has ended in order.
    """
    return _open_leases(events.withColumn("ts", as_instant(F.col("ts"))), lease_seconds)


def lease_orphans(events: DataFrame, lease_seconds: int = LEASE_SECONDS, delay: str = "1 minute") -> DataFrame:
    """The same on a stream, in append mode: a lease comes out once, when the watermark has passed its end, which makes its run an
    orphan. ``delay`` is how late an event may come against the newest; time goes on only where events come, so add
    ticks (rows with a time alone) to a stream that can fall silent."""
    return _open_leases(watermarked(events, "ts", delay), lease_seconds)


def _open_leases(events: DataFrame, lease_seconds: int) -> DataFrame:
    ts, kind = F.col("ts"), F.col("kind")
    sessions = (
        events.groupBy("task_id", "worker_id", F.session_window("ts", f"{lease_seconds} seconds").alias("s"))
        .agg(
            F.max(F.when(kind == "claim", ts)).alias("claimed"),
            F.max(F.when(kind == "finish", ts)).alias("finished"),
            F.max(F.when(kind != "finish", ts)).alias("beat"),
        )
    )
    open_lease = F.col("finished").isNull() | (F.col("finished") < F.col("claimed"))
    return sessions.where(F.col("claimed").isNotNull() & open_lease).select(
        "task_id",
        "worker_id",
        (utc_wall_clock(F.col("beat")) + seconds(lease_seconds)).alias("locked_until"),
    )


LEASE_KEYS = ("task_id", "worker_id")


def start_leases(
    events: DataFrame, path: str, checkpoint: str, lease_seconds: int = LEASE_SECONDS, **trigger
) -> StreamingQuery:
    """Keep the leases of each run and worker; see :func:`leases` and ``batches.current``.

    A beat or finish that arrives late still extends or ends its lease. Those with ``locked_until`` before now
    are the ones to recover."""
    return start_per_key(events, LEASE_KEYS, lambda rows: leases(rows, lease_seconds), path, checkpoint, **trigger)


def start_chain(
    finished: DataFrame,
    load: Callable[[], Tables],
    path: str,
    checkpoint: str,
    now: Callable[[int], TimeLike],
    marks: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Dispatch the dependents of each batch of finished runs that were not looked at before.

    The tables are read again for every batch, only the latest runs of the candidates and their upstreams.
    Runs that earlier batches wrote to ``path`` count as started whether ``load`` sees them or not, so a job fed by
    several batches is dispatched once. ``marks`` gets the successes to be marked as looked at."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        tables = load()
        successes = rows.where(F.col("status") == SUCCESS)
        if "processed_for_chaining" in rows.columns:
            successes = successes.where(~F.col("processed_for_chaining"))
        wanted = candidate_set(successes, tables.edges, tables.jobs)
        latest = latest_state(tables.tasks, wanted)
        below = candidates(successes, tables.edges, tables.jobs)
        ready = generation_guard(ready_jobs(below, tables.edges, latest), latest)
        created = f"job_id {tables.jobs.schema['job_id'].dataType.simpleString()}, created_at TIMESTAMP_NTZ"
        own = read_batches(rows.sparkSession, path, created, 0, batch_id - 1)
        own = own.groupBy("job_id").agg(F.max("created_at").alias("created_at"))
        own = own.withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
        append_tasks(new_runs(generation_guard(ready, own), DEPENDENCY, now(batch_id)), path, batch_id)
        if marks:
            write_batch(successes.withColumn("processed_for_chaining", F.lit(True)), marks, batch_id)

    return start(finished, batch, checkpoint, trigger)


def start_job_changes(changes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the last version of every cron job of a change feed; see :func:`current_snapshot`.

    Disabled jobs are kept as such, so that an older version that is read again cannot bring one
    back: re-read rows change nothing."""
    columns = changed_since(changes).select(*SNAPSHOT_COLUMNS)
    row = F.struct(*SNAPSHOT_COLUMNS)
    last = columns.groupBy("job_id").agg(F.max_by(row, F.struct("updated_at", F.to_json(row).alias("content"))).alias("_row"))
    return start_newest(last.select("_row.*"), path, checkpoint, **trigger)


def current_snapshot(spark: SparkSession, path: str, schema: str, last: int) -> DataFrame:
    """The enabled cron jobs after batch ``last``; ``schema`` is that of ``SNAPSHOT_COLUMNS``."""
    return newest(spark, path, ["job_id"], schema, last).where(F.col("enabled"))


def start_transitions(observations: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Status changes per run across batches; see ``batches.current``. An observation that arrives late changes
    what its neighbours say, as it would have in one batch."""
    columns = observations.select("task_id", "ts", "seq", "status")
    return start_per_key(columns, ["task_id"], status_transitions, path, checkpoint, **trigger)
