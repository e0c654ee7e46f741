"""Job-run tables derived from the driver's parquet tables (see FIXTURES.md)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobruns.functions.times import truncated
from jobruns.session import shared_dir
from jobruns.sources.tables import Tables

NOW = "2001-08-02 00:00:00"
_NOW = f"TIMESTAMP_NTZ'{NOW}'"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a file of a stream; a batch of more is several files.
ROWS_PER_FILE = 1_000_000


def _dealt(rows: DataFrame, folder: str, batches: int) -> int:
    """Write ``rows`` as files for ``batches`` micro-batches, dealt by hash; how many files a batch has."""
    each = max(1, -(-rows.count() // (batches * ROWS_PER_FILE)))
    rows.repartition(batches * each, F.xxhash64(*rows.columns)).write.mode("append").parquet(folder)
    return each


def stream(spark: SparkSession, sf_dir: str, name: str, files: int = 4) -> DataFrame:
    """A base table as a stream of ``files`` micro-batches. Rows are dealt over the files by hash, so
    that no file is older than another and what belongs together arrives apart."""
    table = raw(spark, sf_dir, name)
    folder = f"{shared_dir(spark)}/feed-{uuid.uuid4()}"
    each = _dealt(table, folder, files)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", each).parquet(folder)


def clocked(rows: DataFrame, ts: str, files: int = 4) -> DataFrame:
    """``rows`` as a stream of ``files`` micro-batches in no order, and a last one, years later, that has only a time."""
    folder = f"{shared_dir(rows.sparkSession)}/feed-{uuid.uuid4()}"
    each = _dealt(rows, folder, files)
    tick = rows.agg((F.max(ts) + F.expr("INTERVAL '20' YEAR")).alias(ts))
    tick.select(*[F.col(c) if c == ts else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(folder)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_rows(raw(spark, sf_dir, "customer"))


def job_rows(customer: DataFrame) -> DataFrame:
    return (
        customer.where("c_custkey % 97 <> 0")
        .selectExpr(
            "c_custkey AS job_id",
            "c_name AS name",
            "CASE WHEN c_custkey % 5 < 3 THEN 'scheduled' ELSE 'normal' END AS job_type",
            "CASE c_custkey % 5 WHEN 0 THEN '*/5 * * * *' WHEN 1 THEN '0 2 * * *' WHEN 2 THEN '30 6 1 * 1' END AS cron_expression",
            "CASE WHEN c_nationkey % 2 = 0 THEN 'http' ELSE 'shell' END AS action_type",
            """CASE WHEN c_nationkey % 2 = 0
               THEN '{"method":"post","url":"https://svc.example/' || CAST(c_custkey AS STRING)
                    || '","headers":{"X-Seg":"' || c_mktsegment || '"},"timeout_seconds":'
                    || CAST(c_nationkey + 1 AS STRING) || '}'
               ELSE '{"command":"echo ' || c_mktsegment || '"}' END AS action_config""",
            "c_custkey % 10 <> 7 AS enabled",
            """CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'forbid'
               WHEN c_mktsegment = 'FURNITURE' THEN 'replace' ELSE 'allow' END AS concurrency_policy""",
            "CAST(c_custkey % 4 AS INT) AS max_retries",
            f"CASE WHEN c_custkey % 5 < 3 THEN {_NOW} + INTERVAL '1' SECOND * ((c_custkey % 121) - 60) END AS next_fire_at",
            f"{_NOW} - INTERVAL '1' HOUR * c_custkey AS created_at",
            f"{_NOW} - INTERVAL '1' SECOND * (c_custkey % 40) AS updated_at",
        )
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_rows(raw(spark, sf_dir, "orders"))


def task_rows(orders: DataFrame) -> DataFrame:
    """The task view over an orders frame; works on a stream as well."""
    return (
        orders.selectExpr(
            "o_orderkey AS task_id",
            "o_custkey AS job_id",
            """CASE WHEN o_orderkey % 10 < 6 THEN 'success' WHEN o_orderkey % 10 = 6 THEN 'failed'
               WHEN o_orderkey % 10 = 7 THEN 'final_failed' WHEN o_orderkey % 10 = 8 THEN 'running'
               ELSE 'pending' END AS status""",
            "CASE o_orderkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'scheduled' ELSE 'dependency' END AS trigger_type",
            "CAST(o_orderkey % 4 AS INT) AS retry_count",
            "CASE WHEN o_orderkey % 10 = 8 THEN 'worker-' || CAST(o_custkey % 8 AS STRING) END AS locked_by",
            f"CASE WHEN o_orderkey % 10 = 8 THEN {_NOW} + INTERVAL '1' SECOND * ((o_custkey % 121) - 60) END AS locked_until",
            "o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400) AS created_at",
            "CAST(floor(o_totalprice / 1000) AS BIGINT) AS run_s",
            "(o_orderkey % 10 < 6 AND o_orderkey % 7 <> 0) AS processed_for_chaining",
        )
        .selectExpr(
            "*",
            "CASE WHEN status <> 'pending' THEN created_at + INTERVAL '1' SECOND * (task_id % 60) END AS started_at",
            """CASE WHEN status IN ('success','failed','final_failed')
               THEN created_at + INTERVAL '1' SECOND * (task_id % 60 + run_s) END AS finished_at""",
        )
        .drop("run_s")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of ten jobs with edges +2 and +3 inside a block."""
    keys = raw(spark, sf_dir, "customer").select("c_custkey").where("c_custkey % 97 <> 0")
    steps = keys.select(
        F.col("c_custkey").alias("upstream_job_id"),
        F.explode(F.array(F.lit(2), F.lit(3))).alias("step"),
    ).selectExpr("upstream_job_id", "upstream_job_id + step AS downstream_job_id")
    return steps.where(
        "upstream_job_id - upstream_job_id % 10 = downstream_job_id - downstream_job_id % 10"
    ).join(keys.withColumnRenamed("c_custkey", "downstream_job_id").hint("merge"), "downstream_job_id", "left_semi").select(
        "upstream_job_id", "downstream_job_id"
    )


def edges_with_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that leave some one-time jobs without upstreams."""
    return edges(spark, sf_dir).where("downstream_job_id % 20 NOT IN (3, 7)")


def edges_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = (
        raw(spark, sf_dir, "customer")
        .where("c_custkey % 70 = 9 AND c_custkey % 97 <> 0 AND (c_custkey - 9) % 97 <> 0")
        .selectExpr("c_custkey AS upstream_job_id", "c_custkey - 9 AS downstream_job_id")
    )
    return edges(spark, sf_dir).unionByName(back)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(jobs(spark, sf_dir), tasks(spark, sf_dir), edges(spark, sf_dir))


def routed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).selectExpr(
        "*",
        "CASE WHEN retry_count > 0 THEN 'retry' WHEN trigger_type = 'scheduled' THEN 'scheduled' ELSE 'normal' END AS queue",
    )


def queue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Send, receive and delete of every run, from one pass over the runs."""
    return (
        routed_tasks(spark, sf_dir)
        .selectExpr(
            "task_id",
            "queue",
            "stack(3, 'send', created_at, 'receive', started_at, 'delete', finished_at) AS (op, ts)",
        )
        .where("ts IS NOT NULL")
        .select("task_id", "queue", "ts", "op")
    )


def claim_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS task_id",
        "'worker-' || CAST(l_suppkey AS STRING) AS worker_id",
        "l_linenumber AS seq",
        "l_shipdate AS attempted_at",
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").selectExpr(
        "user_id AS task_id", "'worker-' || CAST(user_id % 8 AS STRING) AS worker_id", "ts"
    )


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").selectExpr(
        "event_type AS series",
        "ts",
        "CAST(row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS DOUBLE) AS value",
    )


def task_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").selectExpr("doc_id AS task_id", "text AS stdout")


# The frames below are inputs that only exist as arguments of an operator.


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution results: every odd document is the output of a successful run."""
    return raw(spark, sf_dir, "documents").selectExpr(
        "doc_id AS task_id", "doc_id % 2 = 1 AS success", "text AS stdout", "lang AS stderr"
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polled states of a thing: (task, time, state), one row per poll."""
    return observation_rows(raw(spark, sf_dir, "events"))


def observation_rows(events: DataFrame) -> DataFrame:
    return events.selectExpr("user_id AS task_id", "ts", "event_id AS seq", "event_type AS status")


def queue_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day and queue what a broker would report; some attributes are missing."""
    return (
        routed_tasks(spark, sf_dir)
        .groupBy("queue", truncated("day", "created_at").alias("ts"))
        .agg(
            F.nullif(F.count_if(F.col("status") == "pending"), F.lit(0)).alias("visible"),
            F.nullif(F.count_if(F.col("status") == "running"), F.lit(0)).alias("not_visible"),
            F.nullif(F.count_if(F.col("status") == "failed"), F.lit(0)).alias("delayed"),
        )
    )


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet inventory: two of three workers were added by scaling, some without a creation time."""
    return raw(spark, sf_dir, "supplier").selectExpr(
        "s_name AS name",
        "s_suppkey % 3 <> 0 AS autoscaled",
        "CASE WHEN s_suppkey % 11 <> 0 THEN concat('2001-08-', lpad(CAST(s_suppkey % 28 + 1 AS STRING), 2, '0')) END AS created",
    )


def faulty_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job view with a fault worked into most rows."""
    return jobs(spark, sf_dir).selectExpr(
        "job_id",
        "CASE job_id % 6 WHEN 1 THEN '  ' WHEN 2 THEN 'dup-' || CAST(job_id % 50 AS STRING) ELSE name END AS name",
        "CASE job_id % 7 WHEN 3 THEN '61 * * * *' WHEN 4 THEN '0 2 * *' WHEN 5 THEN '@daily' WHEN 6 THEN '0 2 L * *' ELSE cron_expression END AS cron_expression",
        "CASE job_id % 11 WHEN 5 THEN 'ftp' ELSE action_type END AS action_type",
        """CASE job_id % 8
           WHEN 1 THEN '{"method":"GET"}'
           WHEN 2 THEN '{"url":"u","command":"c","timeout_seconds":0}'
           WHEN 3 THEN '{"url":"u","command":"c","headers":["a"]}'
           WHEN 4 THEN '{"url":"u","command":"c","body":5}'
           WHEN 5 THEN '{"url":"u","command":"c","timeout_seconds":null,"body":null}'
           WHEN 6 THEN '{"url":5,"command":null,"timeout_seconds":"5"}'
           WHEN 7 THEN '{"url":"u","command":"c","method":null,"timeout_seconds":5.0}'
           ELSE action_config END AS action_config""",
        "CASE WHEN job_id % 9 = 2 THEN 'Allow' ELSE concurrency_policy END AS concurrency_policy",
        "max_retries - 1 AS max_retries",
    )


def job_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed: each job twice, the second version later and with another firing time."""
    return change_rows(raw(spark, sf_dir, "customer"))


def change_rows(customer: DataFrame) -> DataFrame:
    return job_rows(customer).selectExpr(
        "job_id",
        "job_type",
        "explode(array(0, 1)) AS version",
        "enabled",
        "next_fire_at",
        "updated_at",
    ).selectExpr(
        "job_id",
        "job_type",
        "enabled AND NOT (version = 1 AND job_id % 13 = 0) AS enabled",
        "next_fire_at + INTERVAL '1' MINUTE * version AS next_fire_at",
        "updated_at + INTERVAL '1' SECOND * version AS updated_at",
    )


def message_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in every spelling of a body that producers use, and some that carry no id."""
    return message_rows(raw(spark, sf_dir, "orders"))


def message_rows(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS seq",
        "o_orderdate AS ts",
        "'receipt-' || CAST(o_orderkey AS STRING) AS receipt_handle",
        """CASE o_orderkey % 8
           WHEN 0 THEN '{"task_id": "t-' || CAST(o_orderkey AS STRING) || '"}'
           WHEN 1 THEN '"t-' || CAST(o_orderkey AS STRING) || '"'
           WHEN 2 THEN 't-' || CAST(o_orderkey AS STRING)
           WHEN 3 THEN '{"task_id": ' || CAST(o_orderkey AS STRING) || '}'
           WHEN 4 THEN '[' || CAST(o_orderkey AS STRING) || ']'
           WHEN 5 THEN CAST(o_orderkey AS STRING)
           WHEN 6 THEN '{"id": 1}'
           ELSE '' END AS body""",
    )


def partial_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial update of every job: a new name, or switched off with its cron cleared, or another cron, of which
    some are invalid; and an update for each job left out of the job view."""
    return raw(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS job_id",
        f"{_NOW} AS updated_at",
        """CASE c_custkey % 3 WHEN 0 THEN array('name') WHEN 1 THEN array('enabled', 'cron_expression')
           ELSE CASE WHEN c_custkey % 9 < 6 THEN array('cron_expression') ELSE CAST(array() AS ARRAY<STRING>) END END AS fields""",
        "upper(c_name) AS name",
        "false AS enabled",
        "CASE c_custkey % 9 WHEN 2 THEN ' 0 2 * * * ' WHEN 5 THEN '0 2 * *' END AS cron_expression",
    )


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New dependency lists: some close a cycle, some do not, some empty the list."""
    return raw(spark, sf_dir, "customer").where("c_custkey % 97 <> 0 AND c_custkey % 20 IN (4, 8, 15)").selectExpr(
        "c_custkey AS job_id",
        "CASE c_custkey % 20 WHEN 15 THEN 'downstream' ELSE 'upstream' END AS side",
        "CASE c_custkey % 20 WHEN 4 THEN c_custkey + 2 WHEN 15 THEN c_custkey + 1 END AS other_job_id",
    )


def planned_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scheduler planned earlier: exact, off by less than the slack, stale, or for a job that is gone."""
    return raw(spark, sf_dir, "customer").where("c_custkey % 5 < 3").selectExpr(
        "c_custkey AS job_id",
        f"""{_NOW} + INTERVAL '1' SECOND * ((c_custkey % 121) - 60)
            + INTERVAL '0.0005' SECOND * (c_custkey % 4) AS fire_at""",
    )


def edited_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job view after edits: some switched on, some with another configuration."""
    return jobs(spark, sf_dir).selectExpr(
        "job_id",
        "name",
        "job_type",
        "CASE WHEN job_id % 4 = 0 THEN 'http' ELSE action_type END AS action_type",
        """CASE WHEN job_id % 4 = 0
           THEN '{"url":"https://new.example/' || CAST(job_id AS STRING) || '","headers":{"A":"1","B":"2"},"body":{"k":[1, 2],"t":"a, b: c"}}'
           ELSE action_config END AS action_config""",
        "enabled OR job_id % 20 = 7 AS enabled",
    )


def lease_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lease_rows(raw(spark, sf_dir, "events"))


def lease_rows(events: DataFrame) -> DataFrame:
    """Claims, beats and finishes of runs, one worker per run; usable on a stream."""
    return events.selectExpr(
        "user_id AS task_id",
        "'worker-' || CAST(user_id % 8 AS STRING) AS worker_id",
        "ts",
        "CASE WHEN event_id % 3 = 0 THEN 'claim' WHEN event_id % 7 = 0 THEN 'finish' ELSE 'beat' END AS kind",
    )


def paused_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job view before some one-time jobs were switched on."""
    return jobs(spark, sf_dir).withColumn("enabled", F.expr("enabled AND job_id % 20 <> 3"))


def lock_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two beats for every running run, some of them by a worker that does not hold its lock."""
    return raw(spark, sf_dir, "orders").where("o_orderkey % 10 = 8").selectExpr(
        "o_orderkey AS task_id",
        "'worker-' || CAST((o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 8 AS STRING) AS worker_id",
        f"explode(array({_NOW} - INTERVAL '1' SECOND * (o_orderkey % 50), {_NOW} - INTERVAL '1' MINUTE)) AS ts",
    )


def specified_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job view with a specification that is not what action and configuration give, so that one derived anew shows."""
    stored = F.struct(F.lit("stored").alias("image"), F.array(F.lit("true")).alias("command"), F.create_map().cast("map<string,string>").alias("env"), F.lit(1).alias("timeout_seconds"))
    return jobs(spark, sf_dir).withColumn("runtime_spec", stored)


def edit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change for every job, in turn: the next job's name, fewer than no retries, no fields, a configuration that breaks a
    rule, one that breaks none, a new name, an enabled flag that is null, an invalid expression."""
    return raw(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS job_id",
        f"{_NOW} AS updated_at",
        """CASE c_custkey % 10 WHEN 1 THEN array('max_retries') WHEN 2 THEN CAST(NULL AS ARRAY<STRING>)
           WHEN 3 THEN array('action_type', 'action_config') WHEN 4 THEN array('action_config') WHEN 7 THEN array('enabled')
           WHEN 8 THEN array('cron_expression', 'name') ELSE array('name') END AS fields""",
        "CASE WHEN c_custkey % 10 = 0 THEN 'Customer#' || lpad(CAST(c_custkey + 1 AS STRING), 9, '0') ELSE 'renamed-' || CAST(c_custkey AS STRING) END AS name",
        "CAST(NULL AS BOOLEAN) AS enabled",
        "-3 AS max_retries",
        "'http' AS action_type",
        """CASE WHEN c_custkey % 10 = 3 THEN '{"method":"GET"}' ELSE '{"url":"https://new.example/","command":"echo new"}' END AS action_config""",
        "'61 * * * *' AS cron_expression",
    )


def edit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency lists of the same requests: one that closes a circle with an edge there is, one that closes none."""
    return raw(spark, sf_dir, "customer").where("c_custkey % 10 IN (5, 6)").selectExpr(
        "c_custkey AS job_id",
        f"{_NOW} AS updated_at",
        "'upstream' AS side",
        "CASE c_custkey % 10 WHEN 5 THEN c_custkey + 2 ELSE c_custkey - 6 END AS other_job_id",
    )


def edge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency lists asked for one after another; which of two that close a circle together comes first differs."""
    return raw(spark, sf_dir, "customer").where("c_custkey % 97 <> 0 AND c_custkey % 10 IN (0, 1, 4, 8)").selectExpr(
        "c_custkey AS job_id",
        f"{_NOW} + INTERVAL '1' SECOND * (c_custkey % 7) AS requested_at",
        "'upstream' AS side",
        "CASE c_custkey % 10 WHEN 0 THEN c_custkey + 1 WHEN 1 THEN c_custkey - 1 WHEN 4 THEN c_custkey + 2 END AS other_job_id",
    )


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer after the one before: one chain through the whole table."""
    return raw(spark, sf_dir, "customer").where("c_custkey > 1").selectExpr("c_custkey - 1 AS upstream_job_id", "c_custkey AS downstream_job_id")


def worker_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for every line item, several for most runs, some without an id."""
    return raw(spark, sf_dir, "lineitem").selectExpr(
        """CASE WHEN l_linenumber = 3 THEN '{"id": 1}' WHEN l_linenumber = 2 THEN CAST(l_orderkey AS STRING)
           ELSE '{"task_id": "' || CAST(l_orderkey AS STRING) || '"}' END AS body""",
        "'worker-' || CAST(l_suppkey AS STRING) AS worker_id",
        "l_linenumber AS seq",
        "l_shipdate AS ts",
    )
