"""The three tables: typed reading, key lookup, append, cascade delete."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobruns.functions.text import normalise_uuid
from jobruns.functions.times import utc_wall_clock

JOB_COLUMNS = {
    "name": "string",
    "job_type": "string",
    "cron_expression": "string",
    "action_type": "string",
    "action_config": "string",
    "runtime_spec": "struct<image:string,command:array<string>,env:map<string,string>,timeout_seconds:int>",
    "enabled": "boolean",
    "concurrency_policy": "string",
    "max_retries": "int",
    "next_fire_at": "timestamp_ntz",
    "created_at": "timestamp_ntz",
    "updated_at": "timestamp_ntz",
}
TASK_COLUMNS = {
    "status": "string",
    "trigger_type": "string",
    "retry_count": "int",
    "locked_by": "string",
    "locked_until": "timestamp_ntz",
    "started_at": "timestamp_ntz",
    "finished_at": "timestamp_ntz",
    "stdout": "string",
    "stderr": "string",
    "created_at": "timestamp_ntz",
    "processed_for_chaining": "boolean",
}


@dataclass(frozen=True)
class Tables:
    """Job definitions, their runs, and the dependency edges between jobs."""

    jobs: DataFrame
    tasks: DataFrame
    edges: DataFrame

    def with_(self, **frames: DataFrame) -> Tables:
        return replace(self, **frames)


def _typed(df: DataFrame, keys: Sequence[str], columns: dict[str, str], canonical_ids: bool) -> DataFrame:
    """Project onto the expected columns. Columns already stored in the expected type pass through
    untouched, so filters on them still reach the files."""
    have = {f.name: f.dataType for f in df.schema}
    out = [normalise_uuid(F.col(k)).alias(k) if canonical_ids else F.col(k) for k in keys]
    for name, wanted in columns.items():
        if name not in have:
            out.append(F.lit(None).cast(wanted).alias(name))
        elif isinstance(have[name], T.TimestampType):
            out.append(utc_wall_clock(F.col(name)).alias(name))
        elif have[name].simpleString() == wanted:
            out.append(F.col(name))
        else:
            out.append(F.col(name).cast(wanted).alias(name))
    return df.select(*out)


def typed_tables(jobs: DataFrame, tasks: DataFrame, edges: DataFrame, canonical_ids: bool = False) -> Tables:
    """The tables with the expected columns and types; ``canonical_ids`` also normalises UUID keys."""
    return Tables(
        _typed(jobs, ["job_id"], JOB_COLUMNS, canonical_ids),
        _typed(tasks, ["task_id", "job_id"], TASK_COLUMNS, canonical_ids),
        _typed(edges, ["upstream_job_id", "downstream_job_id"], {}, canonical_ids),
    )


def read_tables(spark: SparkSession, path: str, canonical_ids: bool = False) -> Tables:
    """Scan ``jobs``, ``tasks`` and ``job_dependencies`` below ``path``."""
    return typed_tables(
        *(spark.read.parquet(f"{path}/{name}") for name in ("jobs", "tasks", "job_dependencies")),
        canonical_ids=canonical_ids,
    )


def read_tables_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    task_slices: Sequence[str],
    canonical_ids: bool = False,
) -> Tables:
    """The same three tables from a relational database.

    ``task_slices`` are disjoint SQL conditions that together cover the task table, for example one
    per day of ``created_at``; each becomes one partition, so no single task reads all runs.
    """

    def table(name: str, predicates: Sequence[str] | None = None) -> DataFrame:
        reader = spark.read
        if predicates:
            return reader.jdbc(url, name, predicates=list(predicates), properties=properties)
        return reader.jdbc(url, name, properties=properties)

    return typed_tables(
        table("jobs").withColumnRenamed("id", "job_id"),
        table("tasks", task_slices).withColumnRenamed("id", "task_id"),
        table("job_dependencies"),
        canonical_ids,
    )


def lookup(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """Rows whose key is one of ``ids``; an unknown id gives no row. The filter reaches the scan."""
    return df.where(F.col(key).isin(list(ids)))


def append_tasks(new_tasks: DataFrame, path: str, batch_id: str | int, by: Sequence[str] = ()) -> None:
    """Append runs below ``path``. One folder per batch: writing a batch again replaces it,
    so a repeated streaming batch or a retried job adds nothing twice."""
    writer = new_tasks.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(f"{path}/batch_id={batch_id}")


def cascade_delete(tables: Tables, doomed: DataFrame) -> Tables:
    """Remove the jobs in ``doomed`` (column ``job_id``), their runs, and every edge touching them."""
    ids = doomed.select("job_id").distinct()
    return Tables(
        tables.jobs.join(ids, "job_id", "left_anti"),
        tables.tasks.join(ids, "job_id", "left_anti"),
        tables.edges.join(ids.withColumnRenamed("job_id", "upstream_job_id"), "upstream_job_id", "left_anti")
        .join(ids.withColumnRenamed("job_id", "downstream_job_id"), "downstream_job_id", "left_anti")
        .select("upstream_job_id", "downstream_job_id"),
    )
