"""The queries of this package over the driver's tables, by operator name.

Arrays, maps and structs are written out as text and generated run ids are left out, so that every
column compares by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobruns import fixtures as fx
from jobruns.constants import EXTRA_WORKER_BANDS
from jobruns.functions import specs, text
from jobruns.functions.sizing import band, resource_units
from jobruns.functions.times import as_time
from jobruns.operators import (
    aggregates,
    definitions,
    edits,
    graph,
    joins,
    queues,
    runs,
    schedule,
    select,
    windows,
)
from jobruns.plans.scheduler_pass import scheduler_pass
from jobruns.plans.worker_pass import worker_pass
from jobruns.session import shared_dir
from jobruns.sources import messages, tables
from jobruns.streaming import messages as message_streams
from jobruns.streaming import runs as run_streams
from jobruns.streaming.batches import columns_of, current, read_batches, write_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = fx.NOW


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _run_columns(new_runs: DataFrame) -> DataFrame:
    return new_runs.select("job_id", "status", "trigger_type", "retry_count", "created_at", "queue")


def _id_list(column: str):
    return F.array_join(F.col(column), ",").alias(column)


# Sources and sinks


@query
def read_tables(spark, d):
    t, folder = fx.tables(spark, d), f"{shared_dir(spark)}/tables-{uuid.uuid4()}"
    for name, rows in (("jobs", t.jobs), ("tasks", t.tasks.drop("locked_by")), ("job_dependencies", t.edges)):
        rows.write.parquet(f"{folder}/{name}")
    return tables.read_tables(spark, folder).tasks.select(
        "task_id", "job_id", "status", "trigger_type", "retry_count", "created_at", "processed_for_chaining"
    )


@query
def lookup(spark, d):
    return tables.lookup(fx.tasks(spark, d), "task_id", [1, 97, 500, 10**12]).select(
        "task_id", "job_id", "status", "created_at"
    )


@query
def parse_messages(spark, d):
    return messages.parse_messages(fx.message_bodies(spark, d)).select("seq", "body", "task_id", "drop")


@query
def queue_samples(spark, d):
    return messages.queue_samples(fx.queue_gauges(spark, d))


@query
def upsert_jobs(spark, d):
    return _edit(spark, d).jobs.select(
        "job_id", "name", F.col("enabled").cast("string").alias("enabled"), "cron_expression", "job_type", "next_fire_at", "updated_at"
    )


def _edit(spark, d):
    return edits.update_jobs(fx.jobs(spark, d), fx.partial_updates(spark, d), fx.edges(spark, d), NOW)


@query
def refused_updates(spark, d):
    return _edit(spark, d).refused


def _requested(spark, d):
    return edits.update_jobs(fx.specified_jobs(spark, d), fx.edit_requests(spark, d), fx.edges(spark, d), NOW, fx.edit_lists(spark, d))


@query
def edited_jobs(spark, d):
    return _requested(spark, d).jobs.select("job_id", "name", "max_retries", "cron_expression", F.array_join("runtime_spec.command", "|").alias("command"))


@query
def edited_edges(spark, d):
    return _requested(spark, d).edges


@query
def refused_edits(spark, d):
    return _requested(spark, d).refused


@query
def create_jobs(spark, d):
    """Every job of the faulty view offered under a new id and name."""
    name = F.when(F.trim("name") == "", F.col("name")).otherwise(F.concat(F.lit("new "), "name"))
    offered = fx.faulty_jobs(spark, d).withColumns({"job_id": F.col("job_id") + 10_000_000, "enabled": F.lit(True), "name": name})
    made = edits.create_jobs(fx.jobs(spark, d), offered, fx.edges(spark, d), NOW)
    added = made.jobs.where("job_id > 10000000").select("job_id", F.lit("added").alias("outcome"), "job_type", "next_fire_at")
    started = made.new_runs.select("job_id", F.col("queue").alias("outcome"), F.lit(None).cast("string").alias("job_type"), F.lit(None).cast("timestamp_ntz").alias("next_fire_at"))
    return added.unionByName(started)


@query
def cascade_delete(spark, d):
    t = fx.tables(spark, d)
    left = tables.cascade_delete(t, select.filter_jobs(t.jobs, q="r#%1_"))
    return (
        left.jobs.select(F.lit("job").alias("kind"), F.col("job_id").alias("a"), F.col("job_id").alias("b"))
        .unionByName(left.tasks.select(F.lit("task").alias("kind"), F.col("task_id").alias("a"), F.col("job_id").alias("b")))
        .unionByName(
            left.edges.select(
                F.lit("edge").alias("kind"), F.col("upstream_job_id").alias("a"), F.col("downstream_job_id").alias("b")
            )
        )
    )


@query
def metrics_long(spark, d):
    return aggregates.metrics_long(fx.tasks(spark, d), fx.jobs(spark, d), NOW, 86_400)


@query
def append_tasks(spark, d):
    due = schedule.dispatch_due(fx.jobs(spark, d), fx.tasks(spark, d), NOW)
    folder = f"{shared_dir(spark)}/append-{uuid.uuid4()}"
    for _ in range(2):
        tables.append_tasks(due.new_runs, folder, 1, by=["queue"])
    return _run_columns(spark.read.parquet(folder))


# Scalar functions


@query
def normalise_uuid(spark, d):
    digest = F.md5(F.col("c_name"))
    spelled = F.when(F.col("c_custkey") % 3 == 0, F.upper(digest)).when(
        F.col("c_custkey") % 3 == 1, F.concat(F.lit("urn:uuid:"), digest)
    ).otherwise(F.col("c_name"))
    return fx.raw(spark, d, "customer").select("c_custkey", text.normalise_uuid(spelled).alias("id"))


@query
def run_key(spark, d):
    key = text.run_key(F.col("job_id"), F.lit("scheduled"), as_time(NOW), F.lit(0))
    return fx.jobs(spark, d).select("job_id", key.alias("task_id"))


@query
def key_value_map(spark, d):
    items = F.array(
        F.concat(F.lit("NAME="), "s_name"), F.lit("=lost"), F.concat(F.lit("Q=a="), "s_suppkey"), F.lit("FLAG"),
        F.lit("NAME=last"),
    )
    env = text.key_value_map(items)
    return fx.raw(spark, d, "supplier").select(
        "s_suppkey", env["NAME"].alias("name"), env["Q"].alias("q"), env["FLAG"].alias("flag"), F.size(env).alias("keys")
    )


@query
def decode_text(spark, d):
    stored = F.concat(F.encode("text", "UTF-8"), F.lit(b"\xff"))
    decoded = text.decode_text(stored)
    return fx.raw(spark, d, "documents").select("doc_id", F.md5(decoded).alias("md5"))


@query
def env_key_ok(spark, d):
    return fx.raw(spark, d, "orders").select(
        "o_orderkey", text.env_key_ok(F.regexp_replace("o_orderpriority", "^[1-3]-", "")).alias("ok")
    )


@query
def http_config(spark, d):
    c = specs.http_config(F.col("action_config"))
    return fx.edited_jobs(spark, d).where("action_type = 'http'").select(
        "job_id", c["method"].alias("method"), c["url"].alias("url"), F.size(c["headers"]).alias("headers"),
        c["timeout_seconds"].alias("timeout_seconds"),
    )


# Projections, filters, paging


@query
def filter_jobs(spark, d):
    return select.filter_jobs(fx.jobs(spark, d), True, "http", "forbid", "omer#").select(
        "job_id", "name", "enabled", "action_type", "concurrency_policy", "action_config"
    )


@query
def name_contains(spark, d):
    return fx.jobs(spark, d).where(text.name_contains(F.col("name"), "CUST%_7")).select("job_id", "name")


@query
def page(spark, d):
    return select.page(fx.jobs(spark, d), 3, 20).select("job_id", "name", "created_at")


@query
def deep_page(spark, d):
    runs_of_all = fx.tasks(spark, d).select("task_id", "job_id", "created_at")
    return select.page(runs_of_all, 7, 50, key="task_id")


@query
def far_page(spark, d):
    runs_of_all = fx.tasks(spark, d).select("task_id", "job_id", "created_at")
    return select.page(runs_of_all, 250, 50, key="task_id")


@query
def page_envelope(spark, d):
    return select.page_envelope(select.filter_jobs(fx.jobs(spark, d), enabled=True, action_type="shell"), 3, 20)


@query
def runs_of_job(spark, d):
    return select.runs_of_job(fx.tasks(spark, d), 42).select("task_id", "status", "created_at", "finished_at")


@query
def running_per_job(spark, d):
    return select.running_per_job(fx.tasks(spark, d))


@query
def expired_running(spark, d):
    return select.expired_running(fx.tasks(spark, d), NOW).select("task_id", "locked_by", "locked_until")


@query
def unchained_successes(spark, d):
    return select.unchained_successes(fx.tasks(spark, d)).select("task_id", "job_id", "created_at")


@query
def oldest_unchained_batch(spark, d):
    return select.unchained_successes(fx.tasks(spark, d), limit=100).select("task_id", "job_id", "created_at")


@query
def changed_since(spark, d):
    since = as_time(NOW) - F.expr("INTERVAL '10' SECOND")
    return select.changed_since(fx.jobs(spark, d), since).select("job_id", "enabled", "updated_at")


@query
def due_jobs(spark, d):
    return select.in_due_order(select.due_jobs(fx.jobs(spark, d), NOW)).select("job_id", "next_fire_at")


@query
def armed_jobs(spark, d):
    return select.armed_jobs(fx.jobs(spark, d), NOW)


@query
def jobs_by_ids(spark, d):
    ids = fx.tasks(spark, d).where("status = 'running'").select("job_id")
    return select.jobs_by_ids(fx.jobs(spark, d), ids).select("job_id", "name")


@query
def active_runs(spark, d):
    return select.active_runs(fx.tasks(spark, d)).select("task_id", "status")


@query
def settled_runs(spark, d):
    return select.settled_runs(fx.tasks(spark, d)).select("task_id", "status")


@query
def dependency_candidates(spark, d):
    selected = fx.edges(spark, d).where("downstream_job_id = 15").select(F.col("upstream_job_id").alias("job_id"))
    return select.dependency_candidates(fx.jobs(spark, d), 15, selected, q="customer").select("job_id", "name")


@query
def split_by_queue(spark, d):
    routed = fx.routed_tasks(spark, d)
    pools = [select.pending_of_queue(routed, q).select("task_id", "queue") for q in ("normal", "scheduled", "retry")]
    return pools[0].unionByName(pools[1]).unionByName(pools[2])


@query
def scale_down_victims(spark, d):
    return select.scale_down_victims(fx.workers(spark, d), 7).select("name", "created")


# Joins


@query
def runs_with_jobs(spark, d):
    return joins.runs_with_jobs(fx.tasks(spark, d), fx.jobs(spark, d)).select(
        "task_id", "job_id", "name", "job_type", "trigger_type", "created_at", "job_created_at"
    )


@query
def zero_fill(spark, d):
    counts = fx.tasks(spark, d).where("retry_count = 3 AND status <> 'success'").groupBy("status", "trigger_type").count()
    return joins.zero_fill(
        counts,
        {
            "status": ["pending", "running", "success", "failed", "final_failed"],
            "trigger_type": ["manual", "scheduled", "dependency"],
        },
    )


@query
def two_hop(spark, d):
    return joins.two_hop(fx.edges(spark, d), select.unchained_successes(fx.tasks(spark, d)).select("job_id"))


@query
def with_key_in(spark, d):
    return joins.with_key_in(fx.tasks(spark, d), "job_id", fx.edges(spark, d), "downstream_job_id").select(
        "task_id", "job_id"
    )


@query
def jobs_without_upstream(spark, d):
    return joins.jobs_without_upstream(fx.jobs(spark, d), fx.edges(spark, d)).select("job_id", "name")


@query
def runs_without_job(spark, d):
    return joins.runs_without_job(fx.tasks(spark, d), fx.jobs(spark, d))


@query
def adjacency(spark, d):
    return joins.adjacency(fx.jobs(spark, d), fx.edges(spark, d))


@query
def adjacency_lists(spark, d):
    shown = select.page(select.filter_jobs(fx.jobs(spark, d), enabled=True), 2, 100)
    return joins.adjacency_lists(shown, fx.edges(spark, d)).select(
        "job_id", _id_list("upstream_job_ids"), _id_list("downstream_job_ids")
    )


@query
def upstream_state(spark, d):
    return joins.upstream_state(fx.edges(spark, d), windows.latest_state(fx.tasks(spark, d)))


# Aggregations


@query
def table_totals(spark, d):
    return aggregates.table_totals(fx.jobs(spark, d), fx.tasks(spark, d))


@query
def runs_by_status(spark, d):
    return aggregates.runs_by_status(fx.tasks(spark, d))


@query
def status_tiles(spark, d):
    return aggregates.status_tiles(fx.tasks(spark, d))


@query
def jobs_by_enabled_type(spark, d):
    return aggregates.jobs_by_enabled_type(fx.jobs(spark, d))


@query
def runs_by_trigger(spark, d):
    return aggregates.runs_by_trigger(fx.tasks(spark, d))


@query
def runs_by_type_trigger(spark, d):
    return aggregates.runs_by_type_trigger(fx.tasks(spark, d), fx.jobs(spark, d))


@query
def outcome_counters(spark, d):
    return aggregates.outcome_counters(fx.tasks(spark, d))


@query
def recent_throughput(spark, d):
    return aggregates.recent_throughput(fx.tasks(spark, d), NOW, 7 * 86_400)


@query
def active_by_queue(spark, d):
    return aggregates.active_by_queue(fx.tasks(spark, d), fx.jobs(spark, d))


@query
def ready_at(spark, d):
    upstream_runs = fx.edges(spark, d).join(
        windows.latest_state(fx.tasks(spark, d)).withColumnRenamed("job_id", "upstream_job_id"), "upstream_job_id"
    )
    return aggregates.ready_at(upstream_runs)


@query
def queue_depth_total(spark, d):
    return aggregates.queue_depth_total(fx.queue_gauges(spark, d))


@query
def series_summary(spark, d):
    return aggregates.series_summary(fx.metric_samples(spark, d))


@query
def retry_accounting(spark, d):
    return aggregates.retry_accounting(fx.tasks(spark, d), fx.jobs(spark, d))


@query
def dispatch_accounting(spark, d):
    return aggregates.dispatch_accounting(fx.jobs(spark, d), fx.tasks(spark, d), 2)


@query
def sum_by_label(spark, d):
    return aggregates.sum_by_label(fx.metric_samples(spark, d), "series", "c.+|.*r.*")


# Windows


@query
def latest_run_per_job(spark, d):
    return windows.latest_run_per_job(fx.tasks(spark, d).select("job_id", "task_id", "status", "created_at"))


@query
def counter_increase(spark, d):
    return windows.counter_increase(fx.metric_samples(spark, d), 6 * 3600)


@query
def counter_rate(spark, d):
    rates = windows.counter_rate(fx.metric_samples(spark, d), 24 * 3600, 100)
    return rates.withColumn("rate", F.round("rate", 9))


@query
def status_transitions(spark, d):
    return windows.status_transitions(fx.observations(spark, d))


@query
def cumulative_counts(spark, d):
    return windows.cumulative_counts(fx.tasks(spark, d))


@query
def first_claim_per_task(spark, d):
    return windows.first_claim_per_task(fx.claim_attempts(spark, d))


@query
def latest_version_per_job(spark, d):
    return windows.latest_version_per_job(fx.job_changes(spark, d))


# Graph


@query
def descendants(spark, d):
    sources = fx.jobs(spark, d).where("enabled AND action_type = 'http'").select("job_id")
    return graph.descendants(fx.edges_cyclic(spark, d), sources)


@query
def closure(spark, d):
    return graph.closure(fx.edges_cyclic(spark, d))


@query
def jobs_on_cycle(spark, d):
    return graph.jobs_on_cycle(fx.edges_cyclic(spark, d))


@query
def has_cycle(spark, d):
    return (
        graph.has_cycle(fx.edges(spark, d))
        .withColumn("name", F.lit("acyclic"))
        .unionByName(graph.has_cycle(fx.edges_cyclic(spark, d)).withColumn("name", F.lit("cyclic")))
    )


@query
def validate_edges(spark, d):
    return graph.validate_edges(fx.edges(spark, d), fx.proposals(spark, d))


@query
def accept_edges(spark, d):
    return graph.accept_edges(fx.edges(spark, d), fx.edge_requests(spark, d))


@query
def chain_descendants(spark, d):
    chain = fx.chain(spark, d)
    return graph.descendants(chain, chain.where("upstream_job_id = 7").select(F.col("upstream_job_id").alias("job_id")))


@query
def chain_cycles(spark, d):
    """One chain through the whole table, and the same with the way back from its tenth job."""
    chain = fx.chain(spark, d)
    ring = chain.unionByName(chain.where("upstream_job_id = 10").selectExpr("upstream_job_id", "1L AS downstream_job_id"))
    return (
        graph.has_cycle(chain).selectExpr("'chain' AS name", "CAST(has_cycle AS BIGINT) AS n")
        .unionByName(graph.jobs_on_cycle(ring).agg(F.count("*").alias("n")).selectExpr("'ring' AS name", "n"))
    )


@query
def neighbourhood_nodes(spark, d):
    return graph.neighbourhood_nodes(15, fx.jobs(spark, d), fx.edges_cyclic(spark, d))


@query
def neighbourhood_edges(spark, d):
    return graph.neighbourhood_edges(15, fx.edges_cyclic(spark, d))


@query
def candidate_set(spark, d):
    t = fx.tables(spark, d)
    return graph.candidate_set(select.unchained_successes(t.tasks), t.edges, t.jobs)


# Schedules and dispatch


@query
def classify_schedule(spark, d):
    return schedule.classify_schedule(fx.faulty_jobs(spark, d), NOW)


@query
def next_fire(spark, d):
    return schedule.next_fire(fx.jobs(spark, d), NOW).select("job_id", "cron_expression", "fires_at")


@query
def valid_cron(spark, d):
    return schedule.check_cron(fx.faulty_jobs(spark, d)).select("job_id", F.col("cron_ok").alias("valid"))


@query
def fire_calendar(spark, d):
    return schedule.fire_calendar(fx.jobs(spark, d), "2001-08-01 18:00:00", "2001-08-02 06:30:00")


@query
def dispatch_audit(spark, d):
    return schedule.dispatch_audit(fx.jobs(spark, d), fx.tasks(spark, d), "2001-07-01 00:00:00", "2001-08-01 00:00:00")


@query
def missed_firings(spark, d):
    return schedule.missed_firings(fx.jobs(spark, d), fx.tasks(spark, d), "2001-07-28 00:00:00", "2001-08-01 00:00:00")


@query
def dispatch_due_runs(spark, d):
    return _run_columns(schedule.dispatch_due(fx.jobs(spark, d), fx.tasks(spark, d), NOW).new_runs)


@query
def dispatch_due_jobs(spark, d):
    return schedule.dispatch_due(fx.jobs(spark, d), fx.tasks(spark, d), NOW).changed_jobs.select("job_id", "next_fire_at")


@query
def concurrency_gate(spark, d):
    gated = schedule.concurrency_gate(select.due_jobs(fx.jobs(spark, d), NOW), fx.tasks(spark, d))
    return gated.select("job_id", "concurrency_policy", "blocked")


@query
def dispatch_one_time(spark, d):
    return _run_columns(schedule.dispatch_one_time(fx.jobs(spark, d), fx.edges_with_roots(spark, d), NOW))


@query
def dispatch_on_enable(spark, d):
    return _run_columns(
        schedule.dispatch_on_enable(fx.paused_jobs(spark, d), fx.edited_jobs(spark, d), fx.edges_with_roots(spark, d), NOW)
    )


@query
def trigger(spark, d):
    requests = fx.raw(spark, d, "orders").select(
        F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("request_id")
    )
    verdict = schedule.trigger(requests, fx.jobs(spark, d), NOW)
    accepted = verdict.new_runs.select("job_id", F.col("queue").alias("outcome"))
    return accepted.unionByName(verdict.refused.select("job_id", F.col("reason").alias("outcome")))


@query
def route(spark, d):
    return schedule.route_runs(fx.tasks(spark, d)).select("task_id", "queue")


@query
def reconstruct_queue(spark, d):
    return aggregates.reconstruct_queue(fx.tasks(spark, d), fx.jobs(spark, d)).select("task_id", "queue")


@query
def sync_snapshot(spark, d):
    columns = ["job_id", "job_type", "enabled", "next_fire_at", "updated_at"]
    snapshot = fx.jobs(spark, d).where("enabled AND job_type = 'scheduled'").select(*columns)
    return schedule.sync_snapshot(snapshot, fx.job_changes(spark, d).select(*columns), schedule.next_cursor(NOW))


@query
def live_firings(spark, d):
    snapshot = fx.jobs(spark, d).where("enabled AND job_type = 'scheduled'")
    return schedule.live_firings(fx.planned_firings(spark, d), snapshot)


@query
def new_plans(spark, d):
    snapshot = fx.jobs(spark, d).where("enabled AND job_type = 'scheduled'")
    latest = windows.latest_version_per_job(select.changed_since(fx.job_changes(spark, d)))
    return schedule.new_plans(snapshot, latest)


# Runs


@query
def manual_retry(spark, d):
    requests = fx.raw(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") * 3).alias("task_id"))
    verdict = runs.manual_retry(requests, fx.tasks(spark, d), NOW)
    accepted = verdict.new_runs.groupBy("job_id", "trigger_type", "retry_count", "queue").count().select(
        F.concat_ws("/", F.col("job_id"), "trigger_type", F.col("retry_count"), "queue").alias("what"), "count"
    )
    return accepted.unionByName(
        verdict.refused.select(
            F.concat_ws("/", F.col("task_id"), "reason").alias("what"), F.lit(1).cast("long").alias("count")
        )
    )


@query
def apply_results(spark, d):
    outcome = runs.apply_results(fx.results(spark, d), fx.tasks(spark, d), fx.jobs(spark, d), NOW)
    return outcome.finished.select(
        "task_id", "job_id", "status", "stderr", "finished_at",
        F.length("stdout").cast("long").alias("stdout_chars"),
        F.md5("stdout").alias("stdout_md5"),
    )


@query
def result_retries(spark, d):
    outcome = runs.apply_results(fx.results(spark, d), fx.tasks(spark, d), fx.jobs(spark, d), NOW)
    return _run_columns(outcome.retries)


@query
def claim(spark, d):
    return runs.claim(fx.claim_attempts(spark, d), fx.tasks(spark, d), NOW, 30).select(
        "task_id", "job_id", "status", "locked_by", "locked_until", "started_at"
    )


@query
def claim_loss_action(spark, d):
    return runs.claim_loss_action(fx.claim_attempts(spark, d), fx.tasks(spark, d))


def _worked(spark, d):
    return worker_pass(fx.worker_messages(spark, d), fx.results(spark, d), fx.tables(spark, d), NOW)


@query
def worker_pass_messages(spark, d):
    return _worked(spark, d).messages


@query
def worker_pass_runs(spark, d):
    work = _worked(spark, d)
    running = work.claimed.join(work.finished.select("task_id"), "task_id", "left_anti").select("task_id", "status", "locked_by")
    return running.unionByName(work.finished.select("task_id", "status", "locked_by"))


@query
def recover_orphans(spark, d):
    return runs.recover_orphans(fx.tasks(spark, d), NOW).select("task_id", "job_id", "status", "locked_by", "retry_count")


@query
def lease_extension(spark, d):
    return runs.lease_extension(fx.lock_beats(spark, d), fx.tasks(spark, d), 4 * 3600)


@query
def ready_jobs(spark, d):
    latest = windows.latest_state(fx.tasks(spark, d))
    edges = fx.edges(spark, d)
    return runs.ready_jobs(edges.select(F.col("downstream_job_id").alias("job_id")), edges, latest)


@query
def ready_now(spark, d):
    return runs.ready_now(fx.tasks(spark, d), fx.edges(spark, d))


@query
def generation_guard(spark, d):
    latest = windows.latest_state(fx.tasks(spark, d))
    ready = fx.jobs(spark, d).select("job_id", F.col("created_at").alias("ready_at"))
    return runs.generation_guard(ready, latest)


@query
def dispatch_dependents(spark, d):
    t = fx.tables(spark, d)
    return _run_columns(runs.dispatch_dependents(t.tasks, t.jobs, t.edges, NOW).new_runs)


@query
def marked_successes(spark, d):
    t = fx.tables(spark, d)
    return runs.dispatch_dependents(t.tasks, t.jobs, t.edges, NOW).marked.select("task_id", "processed_for_chaining")


@query
def blocked_report(spark, d):
    t = fx.tables(spark, d)
    below = graph.candidates(select.unchained_successes(t.tasks), t.edges, t.jobs)
    return runs.blocked_report(below, t.edges, windows.latest_state(t.tasks))


@query
def scheduler_pass_runs(spark, d):
    return _run_columns(scheduler_pass(fx.tables(spark, d), NOW).new_runs)


@query
def scheduler_pass_tasks(spark, d):
    return scheduler_pass(fx.tables(spark, d), NOW).changed_tasks.select("task_id", "status", "processed_for_chaining")


@query
def truncate_output(spark, d):
    out = text.truncate_output(F.col("stdout"))
    return fx.task_outputs(spark, d).select("task_id", F.length(out).cast("long").alias("chars"), F.md5(out).alias("md5"))


# Queues and fleet


@query
def queue_depth_timeline(spark, d):
    return queues.queue_depth_timeline(fx.queue_messages(spark, d))


@query
def fleet_size(spark, d):
    return aggregates.fleet_size(fx.queue_gauges(spark, d))


@query
def queue_replicas(spark, d):
    return aggregates.queue_replicas(fx.queue_gauges(spark, d))


@query
def scale_action(spark, d):
    sizes = aggregates.fleet_size(fx.queue_gauges(spark, d), per_worker=2).withColumn(
        "current", (F.dayofmonth("ts") % 10 + 1).cast("long")
    )
    return aggregates.scale_action(sizes).select(
        "ts", "desired", "current", "action", "amount", band(F.col("amount"), *EXTRA_WORKER_BANDS).alias("extra_band")
    )


# Definitions


@query
def runtime_spec(spark, d):
    spec = F.col("runtime_spec")
    return definitions.with_runtime_spec(fx.jobs(spark, d)).select(
        "job_id",
        spec["image"].alias("image"),
        F.array_join(spec["command"], "|").alias("command"),
        spec["timeout_seconds"].alias("timeout_seconds"),
    )


@query
def rederive_spec(spark, d):
    spec = F.col("runtime_spec")
    units = resource_units(F.lit(0.5), F.lit(256))
    return definitions.rederive_spec(fx.jobs(spark, d), fx.edited_jobs(spark, d)).select(
        "job_id",
        spec["image"].alias("image"),
        F.array_join(spec["command"], "|").alias("command"),
        units["cpu"].alias("cpu"),
        units["memory"].alias("memory"),
    )


@query
def invalid_jobs(spark, d):
    return definitions.invalid_jobs(fx.faulty_jobs(spark, d))


# Streams: the base table is written as several files, out of the order of time, and read one file per
# micro-batch until all are used up; the result is what was written.


@contextmanager
def _work(spark: SparkSession) -> Iterator[str]:
    """A new folder for a stream's output, with as many state partitions as there are cores."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), cores)))
    try:
        yield f"{shared_dir(spark)}/stream-{uuid.uuid4()}"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _appended(spark: SparkSession, df: DataFrame) -> DataFrame:
    with _work(spark) as folder:
        (
            df.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
        return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _last_batch(query) -> int:
    query.awaitTermination()
    return max(p["batchId"] for p in query.recentProgress)


@query
def message_actions(spark, d):
    arrived = fx.message_rows(fx.stream(spark, d, "orders"))
    known = fx.tasks(spark, d).withColumn("task_id", F.concat(F.lit("t-"), F.col("task_id")))
    actions = message_streams.message_actions(arrived, known)
    return _appended(spark, actions.select("seq", "task_id", "action"))


@query
def dedup_messages(spark, d):
    sent = fx.stream(spark, d, "lineitem").selectExpr(
        "to_json(named_struct('task_id', CAST(l_orderkey AS STRING))) AS body", "l_shipdate AS ts"
    )
    return _appended(spark, message_streams.dedup_messages(sent).select("task_id"))


@query
def throughput_stream(spark, d):
    finished = run_streams.throughput(fx.task_rows(fx.stream(spark, d, "orders")))
    with _work(spark) as folder:
        stream = (
            finished.writeStream.outputMode("complete")
            .foreachBatch(lambda rows, batch_id: write_batch(rows, f"{folder}/out", batch_id))
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        return spark.read.schema(finished.schema).parquet(f"{folder}/out/batch_id={_last_batch(stream)}")


def _of_keys(spark: SparkSession, start, stream: DataFrame, keys, schema: str) -> DataFrame:
    """The outcome of a stream that is worked on key by key."""
    with _work(spark) as folder:
        last = _last_batch(start(stream, folder, f"{folder}/checkpoint"))
        return current(spark, folder, keys, schema, last)


@query
def lease_monitor(spark, d):
    events = fx.lease_rows(fx.stream(spark, d, "events"))

    def start(stream, folder, checkpoint):
        return run_streams.start_leases(stream, folder, checkpoint, 4 * 3600)

    schema = "task_id BIGINT, worker_id STRING, locked_until TIMESTAMP_NTZ"
    return _of_keys(spark, start, events, run_streams.LEASE_KEYS, schema)


@query
def chain_stream(spark, d):
    finished = fx.task_rows(fx.stream(spark, d, "orders"))
    with _work(spark) as folder:
        last = _last_batch(
            run_streams.start_chain(
                finished, lambda: fx.tables(spark, d), f"{folder}/out", f"{folder}/checkpoint", lambda batch_id: NOW
            )
        )
        schema = "job_id BIGINT, status STRING, trigger_type STRING, retry_count INT, created_at TIMESTAMP_NTZ, queue STRING"
        return read_batches(spark, f"{folder}/out", schema, 0, last).drop("batch_id")


@query
def job_changes_stream(spark, d):
    changes = fx.change_rows(fx.stream(spark, d, "customer"))
    schema = columns_of(changes.select(*run_streams.SNAPSHOT_COLUMNS))
    with _work(spark) as folder:
        last = _last_batch(run_streams.start_job_changes(changes, folder, f"{folder}/checkpoint"))
        return run_streams.current_snapshot(spark, folder, schema, last)


@query
def lease_orphans_stream(spark, d):
    return _appended(spark, run_streams.lease_orphans(fx.clocked(fx.lease_events(spark, d), "ts"), 4 * 3600, "7000 days"))


@query
def throughput_sliding_stream(spark, d):
    finished = fx.clocked(fx.tasks(spark, d).where("finished_at IS NOT NULL").select("status", "finished_at"), "finished_at")
    return _appended(spark, run_streams.throughput_sliding(finished, delay="7000 days"))


@query
def transitions_stream(spark, d):
    observed = fx.observation_rows(fx.stream(spark, d, "events"))
    schema = "task_id BIGINT, ts TIMESTAMP_NTZ, seq BIGINT, status STRING, previous STRING, elapsed_s DOUBLE"
    return _of_keys(spark, run_streams.start_transitions, observed, ["task_id"], schema)
