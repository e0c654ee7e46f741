"""Creating and changing job definitions, a set of requests at a time."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobruns.constants import CIRCULAR, INVALID_CRON, JOB_NOT_FOUND
from jobruns.functions.specs import runtime_spec
from jobruns.functions.text import blank_to_null
from jobruns.functions.times import TimeLike, as_time
from jobruns.operators.definitions import invalid_jobs, rules, with_runtime_spec
from jobruns.operators.graph import DOWN, UP, accept_edges, edges_after, jobs_on_cycle
from jobruns.operators.schedule import classify_schedule, dispatch_on_enable, dispatch_one_time, settled
from jobruns.session import cut_lineage

_RESOLVED = ("job_type", "cron_expression", "next_fire_at")


class Edit(NamedTuple):
    """The job table afterwards, the runs that the change starts, the requests refused with their reason, and the
    dependencies afterwards."""

    jobs: DataFrame
    new_runs: DataFrame
    refused: DataFrame
    edges: DataFrame


def _sets(column: str) -> Column:
    return F.array_contains("fields", column)


def merge_changes(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """``jobs`` with the columns that changes name. ``changes`` has ``job_id``, ``updated_at``, an array ``fields`` and
    the columns it may name; a column not named is kept, one named with null is cleared. Several changes of
    one job count in the order of ``updated_at``, of equal times in the order of their content. Changes
    of jobs that are not there add nothing."""
    changed = [c for c in changes.columns if c not in ("job_id", "updated_at", "fields")]
    order = F.struct("updated_at", F.to_json(F.struct(*changed)).alias("content"))
    last = changes.groupBy("job_id").agg(
        F.max("updated_at").alias("_at"),
        *[F.max_by(F.struct(F.col(c).alias("v")), F.when(_sets(c), order)).alias(f"_set_{c}") for c in changed],
    )

    def value(column: str) -> Column:
        if column == "updated_at":
            return F.coalesce("_at", "updated_at").alias(column)
        if column in changed:
            new = F.col(f"_set_{column}")
            return F.when(new.isNotNull(), new["v"]).otherwise(F.col(column)).alias(column)
        return F.col(column)

    return jobs.join(last, "job_id", "left").select(*[value(c) for c in jobs.columns])


#: Columns that a change may name but not empty, where no rule speaks of null already.
_NEVER_NULL = ("name", "enabled", "max_retries")


def _rescheduled(jobs: DataFrame, ids: DataFrame, now: TimeLike, expressions: DataFrame) -> DataFrame:
    """Type, expression and next firing of the jobs in ``ids`` settled anew by their expression."""
    named = jobs.join(ids.select("job_id").distinct(), "job_id", "left_semi")
    new = classify_schedule(named, now, expressions).select("job_id", F.struct(*_RESOLVED).alias("_new"))
    return jobs.join(new, "job_id", "left").select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in _RESOLVED else F.col(c)
            for c in jobs.columns
        ]
    )


def _respecified(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The specification of the jobs in ``ids`` derived anew from action and configuration."""
    moved = ids.select("job_id").distinct().withColumn("_moved", F.lit(True))
    spec = runtime_spec(F.col("action_type"), F.col("action_config"), True)
    new = F.when(F.col("_moved"), spec).otherwise(F.col("runtime_spec"))
    return jobs.join(moved, "job_id", "left").withColumn("runtime_spec", new).select(*jobs.columns)


def _broken(jobs: DataFrame, changes: DataFrame, expressions: DataFrame) -> DataFrame:
    """``job_id, updated_at, reason`` of changes that break a rule by themselves."""
    named = [c for c in changes.columns if c in jobs.columns and c not in ("job_id", "updated_at")]
    old = jobs.select("job_id", F.lit(True).alias("_known"), *[F.col(c).alias(f"_old_{c}") for c in jobs.columns if c not in ("job_id", "updated_at")])
    both = changes.join(old, "job_id", "left")
    # The row as it would be; rules speak of what the change names.
    merged = both.select(
        "job_id",
        "updated_at",
        "fields",
        "_known",
        *[(F.when(_sets(c), F.col(c)).otherwise(F.col(f"_old_{c}")) if c in named else F.col(f"_old_{c}")).alias(c) for c in jobs.columns if c not in ("job_id", "updated_at")],
    )
    known = F.col("_known").isNotNull()
    reasons = [F.when(~known, F.lit(JOB_NOT_FOUND)), F.when(known & F.col("fields").isNull(), F.lit("fields is null"))]
    reasons += [F.when(known & _sets(c) & F.col(c).isNull(), F.lit(f"{c} is null")) for c in _NEVER_NULL if c in named]
    checked = [r for r in rules([]) if r[1] != "empty name"] if set(_RULED) <= set(jobs.columns) else []
    for broken, text, about in checked:
        if touched := [_sets(c) for c in about if c in named]:
            reasons.append(F.when(known & reduce(Column.__or__, touched) & broken, F.lit(text)))
    found = merged.select("job_id", "updated_at", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))
    if "cron_expression" not in named:
        return found
    asked = changes.where(_sets("cron_expression")).select("job_id", "updated_at", blank_to_null(F.col("cron_expression")).alias("cron_expression"))
    wrong = asked.join(expressions.where("NOT valid"), "cron_expression", "left_semi").join(jobs, "job_id", "left_semi")
    return found.unionByName(wrong.select("job_id", "updated_at", F.lit(INVALID_CRON).alias("reason")))


_RULED = ("name", "max_retries", "action_type", "action_config", "concurrency_policy")
_REQUEST = ["job_id", "updated_at"]


def _taken_names(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """``job_id, updated_at, reason`` of changes to a name that another job has, or asks for earlier."""
    asked = changes.where(_sets("name")).select(*_REQUEST, "name")
    first = asked.groupBy("name").agg(F.min(F.struct("updated_at", "job_id"))["job_id"].alias("owner"))
    held = jobs.select("name", F.col("job_id").alias("holder"))
    other = (F.col("holder").isNotNull() & (F.col("holder") != F.col("job_id"))) | (F.col("owner") != F.col("job_id"))
    late = asked.join(first, "name").join(held, "name", "left").where(other)
    return late.select(*_REQUEST, F.lit("duplicate name").alias("reason")).distinct()


def update_jobs(jobs: DataFrame, changes: DataFrame, edges: DataFrame, now: TimeLike, lists: DataFrame | None = None) -> Edit:
    """Apply changes (see :func:`merge_changes`). Setting or clearing the cron expression settles type, expression and
    next firing together; the specification, where ``jobs`` has one, is derived anew where action or configuration is set. A
    one-time job that is switched on, and waits for no upstream, starts.

    ``lists`` (``job_id, updated_at, side, other_job_id``) are dependency lists that changes give, taken in order as in
    :func:`~jobruns.operators.graph.accept_edges`; jobs in them that are not there are left out. The rows of one job and time are one
    request, refused as a whole: for an unknown job, null ``fields``, a value that breaks a rule, a name that another job has
    or asks for earlier (a name given up in the same batch counts as taken), an invalid expression, a circle of dependencies."""
    names = changes.columns
    cron = changes.where(_sets("cron_expression")).select("cron_expression") if "cron_expression" in names else changes.select(F.lit(None).cast("string").alias("cron_expression")).limit(0)
    expressions = cut_lineage(settled(cron, now))
    bad = _broken(jobs, changes, expressions)
    if "name" in names:
        bad = bad.unionByName(_taken_names(jobs, changes.join(bad.select(*_REQUEST), _REQUEST, "left_anti")))
    if lists is not None:
        unknown = lists.join(jobs, "job_id", "left_anti").select(*_REQUEST, F.lit(JOB_NOT_FOUND).alias("reason"))
        bad = cut_lineage(bad.unionByName(unknown))
        there = jobs.select(F.col("job_id").alias("other_job_id"), F.lit(True).alias("_there"))
        asked = lists.join(bad, _REQUEST, "left_anti").join(there, "other_job_id", "left").select(
            "job_id", F.col("updated_at").alias("requested_at"), "side", F.when(F.col("_there"), F.col("other_job_id")).alias("other_job_id")
        )
        asked = cut_lineage(asked)
        verdict = cut_lineage(accept_edges(edges, asked))
        edges = edges_after(edges, asked, verdict)
        circles = verdict.where("NOT accepted").select("job_id", F.col("requested_at").alias("updated_at"), F.lit(CIRCULAR).alias("reason"))
        bad = bad.unionByName(circles)
    bad = cut_lineage(bad.distinct())
    good = changes.join(bad, _REQUEST, "left_anti")
    after = merge_changes(jobs, good)
    if "cron_expression" in names:
        after = _rescheduled(after, good.where(_sets("cron_expression")), now, expressions)
    if "runtime_spec" in jobs.columns and {"action_type", "action_config"} & set(names):
        after = _respecified(after, good.where(_sets("action_type") | _sets("action_config")))
    return Edit(after, dispatch_on_enable(jobs, after, edges, now), bad.select("job_id", "reason"), edges)


def create_jobs(jobs: DataFrame, new: DataFrame, edges: DataFrame, now: TimeLike) -> Edit:
    """Add the definitions in ``new`` that break no rule; enabled one-time jobs without upstreams start.

    ``edges`` are those of the graph with the new jobs' own. Refused definitions come with one row per reason; an id or a name
    that is taken is one, and being on a circle of dependencies. Their edges are left out. Columns of ``jobs`` that ``new``
    lacks are null. Joins whose sides grow with the jobs merge: a broadcast would send its side through the driver."""
    expressions = cut_lineage(settled(new, now))
    broken = invalid_jobs(new, jobs, expressions).unionByName(
        new.join(jobs.select("job_id").hint("merge"), "job_id", "left_semi").select("job_id", F.lit("id is taken").alias("reason"))
    )
    circles = jobs_on_cycle(edges).join(new.select("job_id").hint("merge"), "job_id", "left_semi").select("job_id", F.lit(CIRCULAR).alias("reason"))
    broken = cut_lineage(broken.unionByName(circles))
    accepted = new.join(broken.select("job_id").distinct().hint("merge"), "job_id", "left_anti")
    gone = broken.join(jobs.select("job_id").hint("merge"), "job_id", "left_anti").select("job_id").distinct()
    edges = edges.join(gone.withColumnRenamed("job_id", UP).hint("merge"), UP, "left_anti").join(gone.withColumnRenamed("job_id", DOWN).hint("merge"), DOWN, "left_anti").select(UP, DOWN)
    settled_rows = classify_schedule(accepted, now, expressions).drop("error")
    added = accepted.drop(*_RESOLVED, "created_at", "updated_at").join(settled_rows.hint("merge"), "job_id").withColumns(
        {"created_at": as_time(now), "updated_at": as_time(now)}
    )
    if "runtime_spec" in jobs.columns:
        added = with_runtime_spec(added).drop("spec_error")
    kinds = {f.name: f.dataType for f in jobs.schema}
    rows = added.select(*[F.col(c) if c in added.columns else F.lit(None).cast(kinds[c]).alias(c) for c in jobs.columns])
    return Edit(jobs.unionByName(rows), dispatch_one_time(added, edges, now), broken, edges)
