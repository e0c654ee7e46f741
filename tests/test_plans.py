"""What the physical plans must and must not contain."""

import pytest

from jobruns import fixtures as fx
from jobruns.operators import aggregates, windows
from jobruns.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
# These run jobs while they are built.
EAGER = {"descendants", "closure", "jobs_on_cycle", "has_cycle", "validate_edges", "append_tasks", "message_actions",
         "dedup_messages", "throughput_stream", "lease_monitor", "chain_stream", "job_changes_stream", "transitions_stream"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_no_products_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "Python" not in text and "InPandas" not in text


def test_hot_groups_are_limited_before_the_exchange(spark):
    text = plan(windows.latest_run_per_job(fx.tasks(spark, SF)))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_latest_state_is_a_partial_maximum(spark):
    text = plan(windows.latest_state(fx.tasks(spark, SF)))
    assert "partial_max" in text and "Window" not in text


def test_monitoring_figures_read_the_runs_once(spark):
    text = plan(aggregates.metrics_long(fx.tasks(spark, SF), fx.jobs(spark, SF), fx.NOW))
    assert text.count("orders.parquet") == 1


def test_narrow_queries_read_narrow_columns(spark):
    scans = [line for line in plan(QUERIES["first_claim_per_task"](spark, SF)).splitlines() if "FileScan" in line]
    assert len(scans) == 1
    assert scans[0].split("ReadSchema: struct<")[1].count(":") == 4


def test_runs_are_counted_before_the_join_with_jobs(spark):
    text = plan(QUERIES["runs_by_type_trigger"](spark, SF))
    join = text.index("Join")
    assert "partial_count" in text[join:]


def test_a_hot_job_is_split_in_the_join(spark):
    """A third of all runs belong to job 1; sort-merge splits their partition and loses no row."""
    from jobruns.operators import joins

    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32kb",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        tasks = spark.range(90_000, numPartitions=8).selectExpr(
            "id AS task_id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 5000 END AS job_id", "md5(CAST(id AS STRING)) AS status"
        )
        jobs = spark.range(5000).selectExpr("id AS job_id", "CAST(id AS STRING) AS name")
        df = joins.runs_with_jobs(tasks, jobs)
        assert len(df.collect()) == 90_000
        assert "skew=true" in plan(df)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_worker_pass(table):
    """A message each for a run that succeeds, one that fails, one that still runs, one without a job, one that others hold, one finished, one missing; a second
    message for the first; and a body without an id."""
    from jobruns.plans.worker_pass import worker_pass
    from jobruns.sources.tables import Tables
    from tests.conftest import values

    runs = [(i, 99 if i == 4 else 1, s, "manual", 0) for i, s in ((1, "pending"), (2, "pending"), (3, "pending"), (4, "pending"), (5, "running"), (6, "success"))]
    tasks = table(
        "task_id long, job_id long, status string, trigger_type string, retry_count int, locked_by string, locked_until time, started_at time",
        *[(*r, None, None, None) for r in runs],
    )
    tables = Tables(table("job_id long, max_retries int", (1, 1)), tasks, table("upstream_job_id long, downstream_job_id long"))
    at = "2024-01-01 00:00:0"
    sent = table(
        "body string, worker_id string, seq int, ts time",
        *[(f'{{"task_id": "{i}"}}', "w", 1, at + "1") for i in range(1, 8)], ('{"task_id": "1"}', "late", 1, at + "2"), ("[]", "w", 1, at + "1"), ('{"task_id": "x"}', "w", 1, at + "1"),
    )
    results = table("task_id long, success boolean, stdout string, stderr string", (1, True, "out", ""), (2, False, "", "err"), (6, False, "", "not claimed"))
    work = worker_pass(sent, results, tables, at + "3")
    kept = values(work.messages.where("action = 'keep'"), "body")
    # The late message came while the first one's run was held.
    assert kept == [('{"task_id": "1"}',), ('{"task_id": "3"}',), ('{"task_id": "5"}',)] and work.messages.count() == 10
    assert values(work.claimed, "task_id", "locked_by") == [(i, "w") for i in (1, 2, 3, 4)]
    assert values(work.finished, "task_id", "status", "stderr") == [(1, "success", ""), (2, "failed", "err"), (4, "final_failed", "Job not found")]
    assert values(work.retries, "job_id", "retry_count") == [(1, 1)]


def test_worker_pass_tells_each_message_once(table):
    """Also one without a time or a worker; equal messages are as many as were sent, and only tables of one row per run are cut."""
    from jobruns.plans.worker_pass import worker_pass
    from jobruns.sources.tables import Tables
    from tests.conftest import values

    at = "2024-05-01 10:00:0"
    jobs = table("job_id long, max_retries int", (1, 0))
    kind = "task_id long, job_id long, status string, trigger_type string, retry_count int, locked_by string, locked_until time, started_at time"
    tasks = table(kind, *[(i, 1, s, "manual", 0, None, None, None) for i, s in ((1, "pending"), (2, "pending"), (3, "running"), (4, "failed"))])
    sent = table(
        "body string, worker_id string, seq long, ts time",
        *[
            (f'{{"task_id": "{i}"}}', *rest)
            for i, *rest in ((1, "a", 1, None), (1, "b", 2, at + "1"), (2, None, 1, at + "1"), (2, None, 1, at + "1"), (3, "a", 1, at + "1"), (4, "a", 1, None), (9, None, None, None))
        ],
    )
    results = table("task_id long, success boolean, stdout string, stderr string", (2, True, "", ""))
    work = worker_pass(sent, results, Tables(jobs, tasks, None), at + "3")
    told = [(1, "keep"), (1, "keep"), (2, "delete"), (2, "delete"), (3, "keep"), (4, "delete"), (9, "delete")]
    assert values(work.messages, "body", "action") == [(f'{{"task_id": "{i}"}}', action) for i, action in told]
    assert values(work.claimed, "task_id") == [(1,), (2,)]
