"""Joins between runs, jobs and edges.

No join here is forced to broadcast: adaptive execution broadcasts a side once its real size is
known to be small and otherwise sort-merges, splitting the partition of a job that owns a large
share of all runs.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobruns.constants import FINAL_FAILED, JOB_NOT_FOUND


def runs_with_jobs(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs with the columns of their job; a run whose job is gone drops out."""
    clash = {c: f"job_{c}" for c in jobs.columns if c in tasks.columns and c != "job_id"}
    return tasks.join(jobs.withColumnsRenamed(clash), "job_id")


def zero_fill(counts: DataFrame, dims: dict[str, list[str]], value: str = "count") -> DataFrame:
    """Every combination of the given dimension values, with 0 where ``counts`` has no row."""
    names = list(dims)
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, combo)]) for combo in product(*dims.values())]
    grid = counts.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*rows)))
    return grid.join(counts, names, "left").select(
        *names, F.coalesce(F.col(value), F.lit(0)).cast("double").alias(value)
    )


def two_hop(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges out of the source jobs (``hop`` 1) and all edges into the jobs these lead to (``hop`` 2).

    Kept as edges: pairing every source with every upstream of a shared downstream would square a
    large fan-in, and holds nothing the two edge sets do not."""
    first = edges.join(
        sources.select(F.col("job_id").alias("upstream_job_id")).distinct(), "upstream_job_id", "left_semi"
    )
    second = edges.join(first.select("downstream_job_id").distinct(), "downstream_job_id", "left_semi")
    columns = ["upstream_job_id", "downstream_job_id"]
    return (
        first.select(F.lit(1).alias("hop"), *columns)
        .unionByName(second.select(F.lit(2).alias("hop"), *columns))
    )


def with_key_in(df: DataFrame, key: str, found: DataFrame, found_key: str) -> DataFrame:
    """Rows whose key occurs in an earlier result."""
    return df.join(found.select(F.col(found_key).alias(key)), key, "left_semi")


def jobs_without_upstream(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    return jobs.join(edges.select(F.col("downstream_job_id").alias("job_id")).hint("merge"), "job_id", "left_anti")


def runs_without_job(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs whose job is gone, with the outcome they get."""
    return tasks.join(jobs.select("job_id"), "job_id", "left_anti").select(
        "task_id",
        "job_id",
        F.lit(FINAL_FAILED).alias("status"),
        F.lit("").alias("stdout"),
        F.lit(JOB_NOT_FOUND).alias("stderr"),
    )


def adjacency(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """``job_id, side, neighbour_id``: one row per job and neighbour, ``side`` upstream or downstream. The rows of a
    hub are spread like any others."""
    sides = edges.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("downstream_job_id").alias("job_id"),
                    F.lit("upstream").alias("side"),
                    F.col("upstream_job_id").alias("neighbour_id"),
                ),
                F.struct(
                    F.col("upstream_job_id").alias("job_id"),
                    F.lit("downstream").alias("side"),
                    F.col("downstream_job_id").alias("neighbour_id"),
                ),
            )
        )
    )
    return sides.join(jobs.select("job_id"), "job_id", "left_semi")


def adjacency_lists(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per job of ``shown`` with its sorted ``upstream_job_ids`` and ``downstream_job_ids``, empty when there
    are none. For the jobs of a page: a list holds all neighbours of its job."""
    rows = adjacency(shown, edges)

    def side(name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == name, F.col("neighbour_id")))).alias(f"{name}_job_ids")

    lists = rows.groupBy("job_id").agg(side("upstream"), side("downstream"))
    none = F.array().cast(f"array<{edges.schema['upstream_job_id'].dataType.simpleString()}>")
    return shown.select("job_id").join(lists, "job_id", "left").select(
        "job_id", *[F.coalesce(f"{n}_job_ids", none).alias(f"{n}_job_ids") for n in ("upstream", "downstream")]
    )


def upstream_state(edges: DataFrame, latest: DataFrame) -> DataFrame:
    """Each edge with the latest run of its upstream; ``status`` is null when that never ran."""
    runs = latest.select(
        F.col("job_id").alias("upstream_job_id"),
        "status",
        F.coalesce("finished_at", "created_at").alias("completed_at"),
    )
    return edges.join(runs, "upstream_job_id", "left").select(
        "upstream_job_id", "downstream_job_id", "status", "completed_at"
    )
