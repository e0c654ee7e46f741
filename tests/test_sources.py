"""Reading, appending, partial updates, deleting; what reaches the scan."""

from datetime import datetime

from pyspark.sql import functions as F

from jobruns import fixtures as fx
from jobruns.operators import select
from jobruns.sources import messages, tables
from tests.conftest import values

SF = "/root/testdata/sf0.001"


def stored(spark, tmp_path):
    t = fx.tables(spark, SF)
    t.jobs.write.parquet(f"{tmp_path}/jobs")
    t.tasks.write.parquet(f"{tmp_path}/tasks")
    t.edges.write.parquet(f"{tmp_path}/job_dependencies")
    return str(tmp_path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_files(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    t = tables.read_tables(spark, stored(spark, tmp_path))
    expired = plan(select.expired_running(t.tasks, fx.NOW).select("task_id"))
    assert "EqualTo(status,running)" in expired and "LessThan(locked_until" in expired
    assert "stdout" not in expired.split("ReadSchema")[1]
    due = plan(select.due_jobs(t.jobs, fx.NOW).select("job_id"))
    assert "LessThanOrEqual(next_fire_at" in due and "EqualTo(job_type,scheduled)" in due
    assert "In(task_id" in plan(tables.lookup(t.tasks, "task_id", [1, 2]))


def test_missing_columns_are_null_and_instants_become_utc(spark, tmp_path):
    spark.sql("SELECT 1L AS task_id, 2L AS job_id, 'pending' AS status, TIMESTAMP'2024-01-01 00:00:00 UTC' AS created_at").write.parquet(f"{tmp_path}/tasks")
    jobs = spark.sql("SELECT '{F47AC10B58CC4372A5670E02B2C3D479}' AS job_id")
    edges = spark.createDataFrame([], "upstream_job_id string, downstream_job_id string")
    t = tables.typed_tables(jobs, spark.read.parquet(f"{tmp_path}/tasks"), edges)
    row = t.tasks.first()
    assert row.created_at == datetime(2024, 1, 1) and row.stdout is None
    assert dict(t.tasks.dtypes)["created_at"] == "timestamp_ntz"
    canonical = tables.typed_tables(jobs, spark.read.parquet(f"{tmp_path}/tasks"), edges, canonical_ids=True)
    assert canonical.jobs.first().job_id == "f47ac10b-58cc-4372-a567-0e02b2c3d479"


def test_appending_a_batch_again_replaces_it(spark, tmp_path, table):
    runs = table("task_id string, queue string", ("a", "normal"), ("b", "retry"))
    for _ in range(2):
        tables.append_tasks(runs, str(tmp_path), 7, by=["queue"])
    tables.append_tasks(table("task_id string, queue string", ("c", "normal")), str(tmp_path), 8, by=["queue"])
    assert values(spark.read.parquet(str(tmp_path)), "task_id", "queue", "batch_id") == [
        ("a", "normal", 7), ("b", "retry", 7), ("c", "normal", 8)
    ]


def test_cascade_delete(spark):
    t = fx.tables(spark, SF)
    doomed = select.filter_jobs(t.jobs, q="00001")
    left = tables.cascade_delete(t, doomed)
    ids = [r.job_id for r in doomed.collect()]
    assert ids and left.jobs.where(F.col("job_id").isin(ids)).count() == 0
    assert left.tasks.where(F.col("job_id").isin(ids)).count() == 0
    assert left.edges.where(F.col("upstream_job_id").isin(ids) | F.col("downstream_job_id").isin(ids)).count() == 0
    assert left.jobs.count() + len(ids) == t.jobs.count()


def test_gauges_default_to_zero(table):
    df = table("queue string, visible long, not_visible long, delayed long", ("q", 3, None, None))
    assert values(messages.queue_samples(df)) == [("q", "delayed", 0.0), ("q", "not_visible", 0.0), ("q", "visible", 3.0)]
