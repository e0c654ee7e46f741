"""What workers do with a batch of queue messages, over whole tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobruns.constants import LEASE_SECONDS, PENDING, SETTLED
from jobruns.functions.times import TimeLike
from jobruns.operators.runs import apply_results, claim
from jobruns.operators.windows import first_claim_per_task
from jobruns.session import cut_lineage
from jobruns.sources.messages import parse_messages
from jobruns.sources.tables import Tables


_CLAIM = ("attempted_at", "worker_id", "seq")


class WorkerPass(NamedTuple):
    """The runs that were claimed, the outcome of those that ended, the retries to append, and what becomes of each message."""

    claimed: DataFrame
    finished: DataFrame
    retries: DataFrame
    messages: DataFrame


def worker_pass(
    messages: DataFrame, results: DataFrame, tables: Tables, now: TimeLike, lease_seconds: int = LEASE_SECONDS
) -> WorkerPass:
    """Messages without an id are deleted. Of the messages for a pending run the first claims it, in the order of ``ts``,
    ``worker_id`` and ``seq``; ``results`` (``task_id, success, stdout, stderr``) says how claimed runs that have ended did, and a claimed
    run whose job is gone ends at once. The message of a run that ended is deleted, that of one still running kept; one
    that claimed nothing is deleted when nobody will need it.

    ``messages``: ``body, worker_id, seq, ts``. An id that is no key of the table is that of a run that is gone. Only the runs that
    the batch speaks of are looked at."""
    kind = tables.tasks.schema["task_id"].dataType.simpleString()
    parsed = parse_messages(messages)
    key = F.col("task_id").try_cast(kind)
    parsed = cut_lineage(parsed.withColumn("key", F.when(key.cast("string") == F.col("task_id"), key)))
    unnamed = parsed.where(F.col("key").isNull()).select("body", "worker_id", "seq", "ts", F.lit("delete").alias("action"))
    attempts = parsed.where(F.col("key").isNotNull()).select(
        F.col("key").alias("task_id"), "worker_id", "seq", F.col("ts").alias("attempted_at"), "body"
    )
    # One row per run that the batch speaks of; beside it the messages pass one exchange.
    first = first_claim_per_task(attempts)
    spoken = cut_lineage(tables.tasks.join(first.select("task_id", F.struct(*_CLAIM).alias("_first")), "task_id"))
    claimed = cut_lineage(claim(spoken.select("task_id", "_first.*"), spoken.drop("_first"), now, lease_seconds))
    ended = results.join(claimed.select("task_id"), "task_id", "left_semi")
    gone = claimed.join(tables.jobs, "job_id", "left_anti").join(ended, "task_id", "left_anti")
    lost = gone.select("task_id", F.lit(False).alias("success"), F.lit("").alias("stdout"), F.lit("").alias("stderr"))
    outcome = apply_results(ended.select("task_id", "success", "stdout", "stderr").unionByName(lost), claimed, tables.jobs, now)
    done = outcome.finished.select("task_id", F.lit("delete").alias("_done"))
    status = F.col("status")
    known = spoken.select("task_id", "status", "_first").join(done, "task_id", "left")
    won = (status == PENDING) & F.struct(*_CLAIM).eqNullSafe(F.col("_first"))
    action = F.when(status.isNull() | status.isin(*SETTLED), "delete").when(won, F.coalesce("_done", F.lit("keep"))).otherwise("keep")
    told = attempts.join(known, "task_id", "left").select("worker_id", "seq", "attempted_at", "body", action.alias("action"))
    return WorkerPass(
        claimed,
        outcome.finished,
        outcome.retries,
        told.select("body", "worker_id", "seq", F.col("attempted_at").alias("ts"), "action").unionByName(unnamed),
    )
