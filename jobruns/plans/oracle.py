"""The catalogue's queries in SQL, written independently, for DuckDB over the same base tables."""

from __future__ import annotations

_NOW = "TIMESTAMP '2001-08-02 00:00:00'"

# The fixture views of FIXTURES.md and the operators' further inputs, in order of dependence.
_VIEWS = {
    "jobs": f"""SELECT c_custkey AS job_id, c_name AS name,
      CASE WHEN c_custkey % 5 < 3 THEN 'scheduled' ELSE 'normal' END AS job_type,
      CASE c_custkey % 5 WHEN 0 THEN '*/5 * * * *' WHEN 1 THEN '0 2 * * *' WHEN 2 THEN '30 6 1 * 1' END AS cron_expression,
      CASE WHEN c_nationkey % 2 = 0 THEN 'http' ELSE 'shell' END AS action_type,
      CASE WHEN c_nationkey % 2 = 0
        THEN '{{"method":"post","url":"https://svc.example/' || CAST(c_custkey AS VARCHAR) || '","headers":{{"X-Seg":"' || c_mktsegment || '"}},"timeout_seconds":' || CAST(c_nationkey + 1 AS VARCHAR) || '}}'
        ELSE '{{"command":"echo ' || c_mktsegment || '"}}' END AS action_config,
      c_custkey % 10 <> 7 AS enabled,
      CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'forbid' WHEN c_mktsegment = 'FURNITURE' THEN 'replace' ELSE 'allow' END AS concurrency_policy,
      CAST(c_custkey % 4 AS INT) AS max_retries,
      CASE WHEN c_custkey % 5 < 3 THEN {_NOW} + INTERVAL '1' SECOND * ((c_custkey % 121) - 60) END AS next_fire_at,
      {_NOW} - INTERVAL '1' HOUR * c_custkey AS created_at,
      {_NOW} - INTERVAL '1' SECOND * (c_custkey % 40) AS updated_at,
      c_nationkey, c_mktsegment
    FROM customer WHERE c_custkey % 97 <> 0""",
    "tasks": f"""SELECT t.*,
      CASE WHEN status <> 'pending' THEN created_at + INTERVAL '1' SECOND * (task_id % 60) END AS started_at,
      CASE WHEN status IN ('success','failed','final_failed') THEN created_at + INTERVAL '1' SECOND * (task_id % 60 + run_s) END AS finished_at
    FROM (SELECT o_orderkey AS task_id, o_custkey AS job_id,
      CASE WHEN o_orderkey % 10 < 6 THEN 'success' WHEN o_orderkey % 10 = 6 THEN 'failed' WHEN o_orderkey % 10 = 7 THEN 'final_failed' WHEN o_orderkey % 10 = 8 THEN 'running' ELSE 'pending' END AS status,
      CASE o_orderkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'scheduled' ELSE 'dependency' END AS trigger_type,
      CAST(o_orderkey % 4 AS INT) AS retry_count,
      CASE WHEN o_orderkey % 10 = 8 THEN 'worker-' || CAST(o_custkey % 8 AS VARCHAR) END AS locked_by,
      CASE WHEN o_orderkey % 10 = 8 THEN {_NOW} + INTERVAL '1' SECOND * ((o_custkey % 121) - 60) END AS locked_until,
      o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400) AS created_at,
      CAST(floor(o_totalprice / 1000) AS BIGINT) AS run_s,
      (o_orderkey % 10 < 6 AND o_orderkey % 7 <> 0) AS processed_for_chaining
      FROM orders) t""",
    "edges": """SELECT u.c_custkey AS upstream_job_id, d.c_custkey AS downstream_job_id
    FROM customer u JOIN customer d ON u.c_custkey - u.c_custkey % 10 = d.c_custkey - d.c_custkey % 10
      AND d.c_custkey - u.c_custkey IN (2, 3)
    WHERE u.c_custkey % 97 <> 0 AND d.c_custkey % 97 <> 0""",
    "cyclic": """SELECT upstream_job_id, downstream_job_id FROM edges UNION ALL
    SELECT c_custkey, c_custkey - 9 FROM customer
    WHERE c_custkey % 70 = 9 AND c_custkey % 97 <> 0 AND (c_custkey - 9) % 97 <> 0""",
    "routed": """SELECT *, CASE WHEN retry_count > 0 THEN 'retry' WHEN trigger_type = 'scheduled' THEN 'scheduled' ELSE 'normal' END AS queue FROM tasks""",
    "messages": """SELECT task_id, queue, created_at AS ts, 'send' AS op FROM routed
    UNION ALL SELECT task_id, queue, started_at, 'receive' FROM routed WHERE started_at IS NOT NULL
    UNION ALL SELECT task_id, queue, finished_at, 'delete' FROM routed WHERE finished_at IS NOT NULL""",
    "attempts": """SELECT l_orderkey AS task_id, 'worker-' || CAST(l_suppkey AS VARCHAR) AS worker_id,
      l_linenumber AS seq, l_shipdate AS attempted_at FROM lineitem""",
    "winners": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY attempted_at, worker_id, seq) AS rn
      FROM attempts) WHERE rn = 1""",
    "samples": """SELECT event_type AS series, ts,
      CAST(row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS DOUBLE) AS value FROM events""",
    "steps": """SELECT *, CASE WHEN before IS NULL THEN 0.0 WHEN value < before THEN value ELSE value - before END AS step
    FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, value) AS before FROM samples)""",
    "gauges": """SELECT queue, date_trunc('day', created_at) AS ts,
      nullif(count(*) FILTER (status = 'pending'), 0) AS visible,
      nullif(count(*) FILTER (status = 'running'), 0) AS not_visible,
      nullif(count(*) FILTER (status = 'failed'), 0) AS delayed
    FROM routed GROUP BY 1, 2""",
    "depths": """SELECT ts, CAST(sum(coalesce(visible, 0) + coalesce(not_visible, 0)) AS BIGINT) AS depth FROM gauges GROUP BY ts""",
    "latest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, task_id DESC) AS rn
      FROM tasks) WHERE rn = 1""",
    "upstream": """SELECT e.upstream_job_id, e.downstream_job_id, l.status, coalesce(l.finished_at, l.created_at) AS completed_at
    FROM edges e LEFT JOIN latest l ON l.job_id = e.upstream_job_id""",
    "ready": """SELECT downstream_job_id AS job_id, max(completed_at) AS ready_at FROM upstream
    GROUP BY 1 HAVING count(*) = count(*) FILTER (status = 'success')""",
    "guarded": """SELECT r.job_id, r.ready_at FROM ready r LEFT JOIN latest l ON l.job_id = r.job_id
    WHERE l.job_id IS NULL OR coalesce(l.finished_at, l.created_at) < r.ready_at""",
    "unchained": """SELECT * FROM tasks WHERE status = 'success' AND NOT processed_for_chaining""",
    "below": """SELECT DISTINCT j.job_id FROM unchained t JOIN edges e ON e.upstream_job_id = t.job_id
    JOIN jobs j ON j.job_id = e.downstream_job_id WHERE j.enabled""",
    "minutes": f"""SELECT m, dayofweek(m) AS dow, day(m) AS dom, hour(m) AS h, minute(m) AS mi
    FROM generate_series({_NOW} - INTERVAL 40 DAY, {_NOW} + INTERVAL 40 DAY, INTERVAL 1 MINUTE) g(m)""",
    "firings": """SELECT '*/5 * * * *' AS cron_expression, m FROM minutes WHERE mi % 5 = 0
    UNION ALL SELECT '0 2 * * *', m FROM minutes WHERE h = 2 AND mi = 0
    UNION ALL SELECT '30 6 1 * 1', m FROM minutes WHERE h = 6 AND mi = 30 AND (dom = 1 OR dow = 1)""",
    "next": f"""SELECT cron_expression, min(m) AS fires_at FROM firings WHERE m > {_NOW} GROUP BY 1""",
    "due": f"""SELECT *, concurrency_policy = 'forbid' AND job_id IN (SELECT job_id FROM tasks WHERE status = 'running') AS blocked
    FROM jobs WHERE enabled AND job_type = 'scheduled' AND next_fire_at <= {_NOW}""",
    "changes": """SELECT job_id, job_type, enabled AND NOT (v = 1 AND job_id % 13 = 0) AS enabled,
      next_fire_at + INTERVAL 1 MINUTE * v AS next_fire_at, updated_at + INTERVAL 1 SECOND * v AS updated_at
    FROM jobs, (VALUES (0), (1)) x(v)""",
    "judged": f"""SELECT t.task_id, t.job_id, t.trigger_type, t.retry_count, j.job_id IS NULL AS gone, d.text AS stdout, d.lang AS stderr,
      CASE WHEN j.job_id IS NULL THEN 'final_failed' WHEN d.doc_id % 2 = 1 THEN 'success'
           WHEN t.retry_count >= j.max_retries THEN 'final_failed' ELSE 'failed' END AS status
    FROM documents d JOIN tasks t ON t.task_id = d.doc_id LEFT JOIN jobs j ON j.job_id = t.job_id""",
    "faulty": """SELECT job_id,
      CASE job_id % 6 WHEN 1 THEN '  ' WHEN 2 THEN 'dup-' || CAST(job_id % 50 AS VARCHAR) ELSE name END AS name,
      CASE job_id % 7 WHEN 3 THEN '61 * * * *' WHEN 4 THEN '0 2 * *' WHEN 5 THEN '@daily' WHEN 6 THEN '0 2 L * *' ELSE cron_expression END AS cron_expression,
      CASE job_id % 11 WHEN 5 THEN 'ftp' ELSE action_type END AS action_type,
      CASE WHEN job_id % 9 = 2 THEN 'Allow' ELSE concurrency_policy END AS concurrency_policy,
      max_retries - 1 AS max_retries FROM jobs""",
    "pass_tasks": f"""SELECT CAST(task_id AS VARCHAR) AS task_id, job_id,
      CASE WHEN status = 'running' AND locked_until < {_NOW} THEN 'pending' ELSE status END AS status,
      created_at, finished_at FROM tasks""",
    "pass_due": """SELECT * FROM jobs j WHERE enabled AND job_type = 'scheduled' AND next_fire_at <= TIMESTAMP '2001-08-02 00:00:00'
      AND NOT (concurrency_policy = 'forbid' AND EXISTS (SELECT 1 FROM pass_tasks t WHERE t.job_id = j.job_id AND t.status = 'running'))""",
    "pass_latest": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC) AS rn FROM (
      SELECT job_id, status, created_at, finished_at FROM pass_tasks UNION ALL
      SELECT job_id, 'pending', {_NOW}, NULL FROM pass_due)) WHERE rn = 1""",
    "proposals": """SELECT c_custkey AS job_id, CASE c_custkey % 20 WHEN 15 THEN 'downstream' ELSE 'upstream' END AS side,
      CASE c_custkey % 20 WHEN 4 THEN c_custkey + 2 WHEN 15 THEN c_custkey + 1 END AS other
    FROM customer WHERE c_custkey % 97 <> 0 AND c_custkey % 20 IN (4, 8, 15)""",
    "proposed": """SELECT upstream_job_id, downstream_job_id FROM edges
      WHERE downstream_job_id NOT IN (SELECT job_id FROM proposals WHERE side = 'upstream')
        AND upstream_job_id NOT IN (SELECT job_id FROM proposals WHERE side = 'downstream')
    UNION SELECT other, job_id FROM proposals WHERE side = 'upstream' AND other IS NOT NULL
    UNION SELECT job_id, other FROM proposals WHERE side = 'downstream' AND other IS NOT NULL""",
    "edited": """SELECT job_id, job_type, job_id % 4 = 0 AS changed, enabled AS was_enabled, enabled OR job_id % 20 = 7 AS enabled FROM jobs""",
    "observed": """SELECT user_id AS task_id, ts, event_id AS seq, event_type AS status,
      lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous,
      min(ts) OVER (PARTITION BY user_id) AS first_ts FROM events""",
}
_USES = {
    "edges": [], "cyclic": ["edges"], "routed": ["tasks"], "messages": ["routed"], "winners": ["attempts"],
    "steps": ["samples"], "gauges": ["routed"], "depths": ["gauges"], "latest": ["tasks"],
    "upstream": ["edges", "latest"], "ready": ["upstream"], "guarded": ["ready"], "unchained": ["tasks"],
    "below": ["unchained", "edges", "jobs"], "firings": ["minutes"], "next": ["firings"], "due": ["jobs", "tasks"],
    "changes": ["jobs"], "judged": ["tasks", "jobs"], "faulty": ["jobs"], "pass_tasks": ["tasks"],
    "pass_due": ["jobs", "pass_tasks"], "pass_latest": ["pass_due"], "proposed": ["edges", "proposals"],
    "edited": ["jobs"],
}


def _needed(names: list[str]) -> list[str]:
    found: set[str] = set()

    def add(name: str) -> None:
        if name not in found:
            for other in _USES.get(name, []):
                add(other)
            found.add(name)

    for name in names:
        add(name)
    return [v for v in _VIEWS if v in found]


def _sql(views: str, body: str) -> str:
    ctes = [f"{'nxt' if v == 'next' else v} AS ({_VIEWS[v]})" for v in _needed(views.split())]
    if body.startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[5:]])
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body


_REACH = """reach AS (SELECT upstream_job_id AS a, downstream_job_id AS d FROM {edges} UNION
  SELECT r.a, e.downstream_job_id FROM reach r JOIN {edges} e ON e.upstream_job_id = r.d)"""
_QUEUE = """CASE WHEN retry_count > 0 THEN 'retry' WHEN trigger_type = 'scheduled' AND job_type = 'scheduled' THEN 'scheduled' ELSE 'normal' END"""
_NEW_RUN = f"'pending' AS status, '{{trigger}}' AS trigger_type, 0 AS retry_count, {_NOW} AS created_at, '{{queue}}' AS queue"
_RUNTIME = """CASE WHEN c_nationkey % 2 = 0
  THEN 'curl|-fsS|-X|POST|-H|X-Seg: ' || c_mktsegment || '|https://svc.example/' || CAST(job_id AS VARCHAR)
  ELSE 'sh|-c|echo ' || c_mktsegment END"""


def _new_run(trigger: str, queue: str) -> str:
    return _NEW_RUN.format(trigger=trigger, queue=queue)


_INVALID = """SELECT job_id, reason FROM (
      SELECT job_id, 'empty name' AS reason FROM faulty WHERE trim(name) = ''
      UNION ALL SELECT job_id, 'negative max_retries' FROM faulty WHERE max_retries < 0
      UNION ALL SELECT job_id, 'unknown action_type' FROM faulty WHERE action_type NOT IN ('http', 'shell')
      UNION ALL SELECT job_id, 'unknown concurrency_policy' FROM faulty WHERE concurrency_policy NOT IN ('allow', 'forbid', 'replace')
      UNION ALL SELECT job_id, 'missing url' FROM faulty WHERE action_type = 'http' AND job_id % 8 IN (1, 6)
      UNION ALL SELECT job_id, 'method is not text' FROM faulty WHERE action_type = 'http' AND job_id % 8 = 7
      UNION ALL SELECT job_id, 'missing command' FROM faulty WHERE action_type = 'shell' AND job_id % 8 IN (1, 6)
      UNION ALL SELECT job_id, 'timeout_seconds below 1' FROM faulty WHERE action_type IN ('http', 'shell') AND job_id % 8 IN (2, 5)
      UNION ALL SELECT job_id, 'headers are not an object of strings' FROM faulty WHERE action_type = 'http' AND job_id % 8 = 3
      UNION ALL SELECT job_id, 'body is neither text nor object' FROM faulty WHERE action_type = 'http' AND job_id % 8 = 4
      UNION ALL SELECT job_id, 'duplicate name' FROM faulty WHERE name IN (SELECT name FROM faulty GROUP BY name HAVING count(*) > 1)
      UNION ALL SELECT job_id, 'Invalid cron expression' FROM faulty WHERE job_id % 7 IN (3, 4))"""


# A job of the third kind asks for an upstream job that it leads to, if that one is there.
_CIRCLE = "(j.job_id + 2 IN (SELECT job_id FROM jobs))"

ORACLE: dict[str, str] = {
    # Sources and sinks
    "read_tables": _sql("tasks", "SELECT task_id, job_id, status, trigger_type, retry_count, created_at, processed_for_chaining FROM tasks"),
    "lookup": _sql("tasks", "SELECT task_id, job_id, status, created_at FROM tasks WHERE task_id IN (1, 97, 500, 1000000000000)"),
    "parse_messages": """SELECT o_orderkey AS seq,
      CASE o_orderkey % 8 WHEN 0 THEN '{"task_id": "t-' || k || '"}' WHEN 1 THEN '"t-' || k || '"' WHEN 2 THEN 't-' || k
        WHEN 3 THEN '{"task_id": ' || k || '}' WHEN 4 THEN '[' || k || ']' WHEN 5 THEN k WHEN 6 THEN '{"id": 1}' ELSE '' END AS body,
      CASE WHEN o_orderkey % 8 < 3 THEN 't-' || k WHEN o_orderkey % 8 = 3 THEN k END AS task_id,
      o_orderkey % 8 > 3 AS "drop"
      FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)""",
    "queue_samples": _sql("gauges", """SELECT queue, ts, 'visible' AS metric, CAST(coalesce(visible, 0) AS DOUBLE) AS value FROM gauges
      UNION ALL SELECT queue, ts, 'not_visible', CAST(coalesce(not_visible, 0) AS DOUBLE) FROM gauges
      UNION ALL SELECT queue, ts, 'delayed', CAST(coalesce(delayed, 0) AS DOUBLE) FROM gauges"""),
    "upsert_jobs": _sql("jobs", f"""SELECT c.c_custkey AS job_id,
      CASE WHEN c.c_custkey % 3 = 0 THEN upper(c.c_name) ELSE j.name END AS name,
      CAST(CASE WHEN c.c_custkey % 3 = 1 THEN false ELSE j.enabled END AS VARCHAR) AS enabled,
      CASE WHEN c.c_custkey % 3 = 1 THEN NULL WHEN c.c_custkey % 9 = 2 THEN '0 2 * * *' ELSE j.cron_expression END AS cron_expression,
      CASE WHEN c.c_custkey % 3 = 1 THEN 'normal' WHEN c.c_custkey % 9 = 2 THEN 'scheduled' ELSE j.job_type END AS job_type,
      CASE WHEN c.c_custkey % 3 = 1 THEN NULL WHEN c.c_custkey % 9 = 2 THEN TIMESTAMP '2001-08-02 02:00:00' ELSE j.next_fire_at END AS next_fire_at,
      CASE WHEN c.c_custkey % 9 = 5 THEN j.updated_at ELSE {_NOW} END AS updated_at
      FROM customer c JOIN jobs j ON j.job_id = c.c_custkey"""),
    "refused_updates": """SELECT c_custkey AS job_id, 'Job not found' AS reason FROM customer WHERE c_custkey % 97 = 0
      UNION ALL SELECT c_custkey, 'Invalid cron expression' FROM customer WHERE c_custkey % 97 <> 0 AND c_custkey % 9 = 5""",
    "edited_jobs": _sql("jobs", f"""SELECT job_id, CASE WHEN job_id % 10 IN (6, 9) OR job_id % 10 = 5 AND NOT {_CIRCLE} THEN 'renamed-' || CAST(job_id AS VARCHAR)
        WHEN job_id % 10 = 0 AND 'Customer#' || lpad(CAST(job_id + 1 AS VARCHAR), 9, '0') NOT IN (SELECT name FROM jobs) THEN 'Customer#' || lpad(CAST(job_id + 1 AS VARCHAR), 9, '0')
        ELSE name END AS name, max_retries, cron_expression,
      CASE WHEN job_id % 10 <> 4 THEN 'true' WHEN action_type = 'http' THEN 'curl|-fsS|-X|GET|https://new.example/' ELSE 'sh|-c|echo new' END AS command FROM jobs j"""),
    "edited_edges": _sql("edges jobs", f"""SELECT e.* FROM edges e JOIN jobs j ON j.job_id = e.downstream_job_id
      WHERE NOT (job_id % 10 = 6 OR job_id % 10 = 5 AND NOT {_CIRCLE})
      UNION ALL SELECT job_id - 6, job_id FROM jobs WHERE job_id % 10 = 6 AND job_id - 6 IN (SELECT job_id FROM jobs)"""),
    "refused_edits": _sql("jobs", f"""SELECT c_custkey AS job_id, 'Job not found' AS reason FROM customer WHERE c_custkey % 97 = 0
      UNION ALL SELECT * FROM (SELECT job_id, CASE job_id % 10
        WHEN 0 THEN CASE WHEN 'Customer#' || lpad(CAST(job_id + 1 AS VARCHAR), 9, '0') IN (SELECT name FROM jobs) THEN 'duplicate name' END
        WHEN 1 THEN 'negative max_retries' WHEN 2 THEN 'fields is null' WHEN 3 THEN 'missing url'
        WHEN 5 THEN CASE WHEN {_CIRCLE} THEN 'Circular dependency detected' END
        WHEN 7 THEN 'enabled is null' WHEN 8 THEN 'Invalid cron expression' END AS reason FROM jobs j) WHERE reason IS NOT NULL"""),
    "create_jobs": _sql("faulty next", f""", broken AS ({_INVALID}), made AS (SELECT f.* FROM faulty f WHERE job_id NOT IN (SELECT job_id FROM broken))
      SELECT m.job_id + 10000000 AS job_id, 'added' AS outcome, CASE WHEN m.cron_expression IS NULL THEN 'normal' ELSE 'scheduled' END AS job_type,
        CASE m.job_id % 7 WHEN 5 THEN TIMESTAMP '2001-08-03 00:00:00' WHEN 6 THEN TIMESTAMP '2001-08-31 02:00:00' ELSE n.fires_at END AS next_fire_at
      FROM made m LEFT JOIN nxt n ON n.cron_expression = m.cron_expression
      UNION ALL SELECT job_id + 10000000, 'normal', NULL, NULL FROM made WHERE cron_expression IS NULL"""),
    "cascade_delete": _sql("jobs tasks edges", """, doomed AS (SELECT job_id FROM jobs WHERE lower(name) LIKE '%r#%1_%')
      SELECT 'job' AS kind, job_id AS a, job_id AS b FROM jobs WHERE job_id NOT IN (SELECT job_id FROM doomed)
      UNION ALL SELECT 'task', task_id, job_id FROM tasks WHERE job_id NOT IN (SELECT job_id FROM doomed)
      UNION ALL SELECT 'edge', upstream_job_id, downstream_job_id FROM edges
        WHERE upstream_job_id NOT IN (SELECT job_id FROM doomed) AND downstream_job_id NOT IN (SELECT job_id FROM doomed)"""),
    "metrics_long": _sql("jobs tasks", f"""SELECT metric, coalesce(labels, '') AS labels, type, CAST(value AS DOUBLE) AS value FROM (
      SELECT 'tasks_by_status_count' AS metric, 'status=' || status AS labels, 'gauge' AS type, count(*) AS value FROM tasks GROUP BY status
      UNION ALL SELECT 'tasks_recent_throughput_success_per_min', '', 'gauge', count(*) FROM tasks WHERE status = 'success' AND finished_at > {_NOW} - INTERVAL 1 DAY
      UNION ALL SELECT 'tasks_recent_throughput_failed_per_min', '', 'gauge', count(*) FROM tasks WHERE status IN ('failed', 'final_failed') AND finished_at > {_NOW} - INTERVAL 1 DAY
      UNION ALL SELECT 'tasks_created_total', '', 'counter', count(*) FROM tasks
      UNION ALL SELECT 'tasks_succeeded_total', '', 'counter', count(*) FROM tasks WHERE status = 'success'
      UNION ALL SELECT 'tasks_failed_total', '', 'counter', count(*) FROM tasks WHERE status IN ('failed', 'final_failed')
      UNION ALL SELECT 'tasks_retried_total', '', 'counter', count(*) FROM tasks WHERE retry_count > 0
      UNION ALL SELECT 'tasks_final_failed_total', '', 'counter', count(*) FROM tasks WHERE status = 'final_failed'
      UNION ALL SELECT 'jobs_total_count', '', 'gauge', count(*) FROM jobs
      UNION ALL SELECT 'jobs_by_enabled_count', 'enabled=' || CAST(enabled AS VARCHAR) || ',job_type=' || job_type, 'gauge', count(*) FROM jobs GROUP BY enabled, job_type
      UNION ALL SELECT 'tasks_by_trigger_total', 'trigger_type=' || trigger_type, 'counter', count(*) FROM tasks GROUP BY trigger_type
      UNION ALL SELECT 'scheduler_jobs_upcoming_count', '', 'gauge', count(*) FROM jobs WHERE enabled AND job_type = 'scheduled' AND next_fire_at >= {_NOW}
      UNION ALL SELECT 'tasks_active_by_queue_count', 'queue=' || b.q || ',status=' || b.s, 'gauge', coalesce(c.n, 0) FROM
        (SELECT q, s FROM (VALUES ('normal'), ('retry'), ('scheduled')) x(q), (VALUES ('pending'), ('running')) y(s)) b
        LEFT JOIN (SELECT {_QUEUE} AS q, status AS s, count(*) AS n FROM tasks JOIN jobs USING (job_id) WHERE status IN ('pending', 'running') GROUP BY 1, 2) c ON c.q = b.q AND c.s = b.s
      UNION ALL SELECT 'tasks_by_job_and_trigger_count', 'job_type=' || job_type || ',trigger_type=' || trigger_type, 'gauge', count(*)
        FROM tasks JOIN jobs USING (job_id) GROUP BY job_type, trigger_type)"""),
    "append_tasks": _sql("due", f"SELECT job_id, {_new_run('scheduled', 'scheduled')} FROM due WHERE NOT blocked"),
    # Scalar functions
    "normalise_uuid": """SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN
        h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] END AS id
      FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)""",
    "run_key": _sql("jobs", """SELECT job_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS task_id
      FROM (SELECT job_id, sha256(job_id || '|scheduled|2001-08-02 00:00:00|0') AS h FROM jobs)"""),
    "key_value_map": "SELECT s_suppkey, 'last' AS name, 'a=' || s_suppkey AS q, '' AS flag, 3 AS keys FROM supplier",
    "decode_text": "SELECT doc_id, md5(text || chr(65533)) AS md5 FROM documents",
    "env_key_ok": """SELECT o_orderkey, regexp_full_match(regexp_replace(o_orderpriority, '^[1-3]-', ''), '[A-Za-z_][A-Za-z0-9_]*') AS ok FROM orders""",
    "http_config": _sql("jobs", """SELECT job_id, CASE WHEN job_id % 4 = 0 THEN 'GET' ELSE 'post' END AS method,
      CASE WHEN job_id % 4 = 0 THEN 'https://new.example/' ELSE 'https://svc.example/' END || job_id AS url,
      CASE WHEN job_id % 4 = 0 THEN 2 ELSE 1 END AS headers, CASE WHEN job_id % 4 = 0 THEN 30 ELSE c_nationkey + 1 END AS timeout_seconds
      FROM jobs WHERE job_id % 4 = 0 OR action_type = 'http'"""),
    # Projections, filters, paging
    "filter_jobs": _sql("jobs", """SELECT job_id, name, enabled, action_type, concurrency_policy, action_config FROM jobs
      WHERE enabled AND action_type = 'http' AND concurrency_policy = 'forbid' AND contains(lower(name), 'omer#')"""),
    "name_contains": _sql("jobs", "SELECT job_id, name FROM jobs WHERE lower(name) LIKE '%cust%_7%'"),
    "page": _sql("jobs", "SELECT job_id, name, created_at FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 20 OFFSET 40"),
    "deep_page": _sql("tasks", "SELECT task_id, job_id, created_at FROM tasks ORDER BY created_at DESC, task_id DESC LIMIT 50 OFFSET 300"),
    "far_page": _sql("tasks", "SELECT task_id, job_id, created_at FROM tasks ORDER BY created_at DESC, task_id DESC LIMIT 50 OFFSET 12450"),
    "page_envelope": _sql("jobs", """SELECT CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_size, n AS total,
      CAST(greatest(ceil(n / 20), 1) AS BIGINT) AS total_pages,
      CAST(CASE WHEN n = 0 THEN 0 ELSE 41 END AS BIGINT) AS first_item,
      CAST(CASE WHEN n = 0 THEN 0 ELSE 40 + greatest(least(n - 40, 20), 0) END AS BIGINT) AS last_item
      FROM (SELECT count(*) AS n FROM jobs WHERE enabled AND action_type = 'shell')"""),
    "runs_of_job": _sql("tasks", "SELECT task_id, status, created_at, finished_at FROM tasks WHERE job_id = 42"),
    "running_per_job": _sql("tasks", "SELECT job_id, count(*) AS running FROM tasks WHERE status = 'running' GROUP BY job_id"),
    "expired_running": _sql("tasks", f"SELECT task_id, locked_by, locked_until FROM tasks WHERE status = 'running' AND locked_until < {_NOW}"),
    "unchained_successes": _sql("unchained", "SELECT task_id, job_id, created_at FROM unchained"),
    "oldest_unchained_batch": _sql("unchained", "SELECT task_id, job_id, created_at FROM unchained ORDER BY created_at, task_id LIMIT 100"),
    "changed_since": _sql("jobs", f"SELECT job_id, enabled, updated_at FROM jobs WHERE job_type = 'scheduled' AND updated_at >= {_NOW} - INTERVAL 10 SECOND"),
    "due_jobs": _sql("jobs", f"SELECT job_id, next_fire_at FROM jobs WHERE enabled AND job_type = 'scheduled' AND next_fire_at <= {_NOW} ORDER BY 2, 1"),
    "armed_jobs": _sql("jobs", f"SELECT CAST(count(*) AS DOUBLE) AS armed FROM jobs WHERE enabled AND job_type = 'scheduled' AND next_fire_at >= {_NOW}"),
    "jobs_by_ids": _sql("jobs tasks", "SELECT job_id, name FROM jobs WHERE job_id IN (SELECT job_id FROM tasks WHERE status = 'running')"),
    "active_runs": _sql("tasks", "SELECT task_id, status FROM tasks WHERE status IN ('pending', 'running')"),
    "settled_runs": _sql("tasks", "SELECT task_id, status FROM tasks WHERE status NOT IN ('pending', 'running')"),
    "dependency_candidates": _sql("jobs edges", """SELECT job_id, name FROM
      (SELECT job_id, name FROM jobs WHERE lower(name) LIKE '%customer%' ORDER BY created_at DESC, job_id DESC LIMIT 50)
      WHERE job_id <> 15 AND job_id NOT IN (SELECT upstream_job_id FROM edges WHERE downstream_job_id = 15)"""),
    "split_by_queue": _sql("routed", "SELECT task_id, queue FROM routed WHERE status = 'pending'"),
    "scale_down_victims": """SELECT name, created FROM (SELECT s_name AS name, s_suppkey,
      CASE WHEN s_suppkey % 11 <> 0 THEN '2001-08-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') END AS created FROM supplier)
      WHERE s_suppkey % 3 <> 0 ORDER BY coalesce(created, ''), name LIMIT 7""",
    # Joins
    "runs_with_jobs": _sql("jobs tasks", """SELECT t.task_id, t.job_id, j.name, j.job_type, t.trigger_type, t.created_at, j.created_at AS job_created_at
      FROM tasks t JOIN jobs j ON j.job_id = t.job_id"""),
    "zero_fill": _sql("tasks", """SELECT s AS status, t AS trigger_type,
      CAST((SELECT count(*) FROM tasks k WHERE k.retry_count = 3 AND k.status <> 'success' AND k.status = s AND k.trigger_type = t) AS DOUBLE) AS count
      FROM (VALUES ('pending'), ('running'), ('success'), ('failed'), ('final_failed')) x(s),
        (VALUES ('manual'), ('scheduled'), ('dependency')) y(t)"""),
    "two_hop": _sql("unchained edges", """, one AS (SELECT * FROM edges WHERE upstream_job_id IN (SELECT job_id FROM unchained))
      SELECT 1 AS hop, upstream_job_id, downstream_job_id FROM one
      UNION ALL SELECT 2, upstream_job_id, downstream_job_id FROM edges WHERE downstream_job_id IN (SELECT downstream_job_id FROM one)"""),
    "with_key_in": _sql("tasks edges", "SELECT task_id, job_id FROM tasks WHERE job_id IN (SELECT downstream_job_id FROM edges)"),
    "jobs_without_upstream": _sql("jobs edges", "SELECT job_id, name FROM jobs WHERE job_id NOT IN (SELECT downstream_job_id FROM edges)"),
    "runs_without_job": _sql("jobs tasks", """SELECT task_id, job_id, 'final_failed' AS status, '' AS stdout, 'Job not found' AS stderr
      FROM tasks WHERE job_id NOT IN (SELECT job_id FROM jobs)"""),
    "adjacency": _sql("jobs edges", """SELECT downstream_job_id AS job_id, 'upstream' AS side, upstream_job_id AS neighbour_id FROM edges
      WHERE downstream_job_id IN (SELECT job_id FROM jobs)
      UNION ALL SELECT upstream_job_id, 'downstream', downstream_job_id FROM edges WHERE upstream_job_id IN (SELECT job_id FROM jobs)"""),
    "adjacency_lists": _sql("jobs edges", """SELECT job_id,
      coalesce((SELECT string_agg(CAST(upstream_job_id AS VARCHAR), ',' ORDER BY upstream_job_id) FROM edges WHERE downstream_job_id = job_id), '') AS upstream_job_ids,
      coalesce((SELECT string_agg(CAST(downstream_job_id AS VARCHAR), ',' ORDER BY downstream_job_id) FROM edges WHERE upstream_job_id = job_id), '') AS downstream_job_ids
      FROM (SELECT job_id FROM jobs WHERE enabled ORDER BY created_at DESC, job_id DESC LIMIT 100 OFFSET 100)"""),
    "upstream_state": _sql("upstream", "SELECT * FROM upstream"),
    # Aggregations
    "table_totals": _sql("jobs tasks", "SELECT 'jobs' AS name, count(*) AS total FROM jobs UNION ALL SELECT 'tasks', count(*) FROM tasks"),
    "runs_by_status": _sql("tasks", "SELECT status, CAST(count(*) AS DOUBLE) AS count FROM tasks GROUP BY status"),
    "status_tiles": _sql("tasks", """SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running,
      count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
      count(*) FILTER (status = 'final_failed') AS final_failed FROM tasks"""),
    "jobs_by_enabled_type": _sql("jobs", "SELECT CAST(enabled AS VARCHAR) AS enabled, job_type, CAST(count(*) AS DOUBLE) AS count FROM jobs GROUP BY 1, 2"),
    "runs_by_trigger": _sql("tasks", "SELECT trigger_type, CAST(count(*) AS DOUBLE) AS total FROM tasks GROUP BY 1"),
    "runs_by_type_trigger": _sql("jobs tasks", """SELECT job_type, trigger_type, CAST(count(*) AS DOUBLE) AS count
      FROM tasks JOIN jobs USING (job_id) GROUP BY 1, 2"""),
    "outcome_counters": _sql("tasks", """SELECT CAST(count(*) AS DOUBLE) AS created_total,
      CAST(count(*) FILTER (status = 'success') AS DOUBLE) AS succeeded_total,
      CAST(count(*) FILTER (status IN ('failed', 'final_failed')) AS DOUBLE) AS failed_total,
      CAST(count(*) FILTER (retry_count > 0) AS DOUBLE) AS retried_total,
      CAST(count(*) FILTER (status = 'final_failed') AS DOUBLE) AS final_failed_total FROM tasks"""),
    "recent_throughput": _sql("tasks", f"""SELECT CAST(count(*) FILTER (status = 'success') AS DOUBLE) AS success_per_min,
      CAST(count(*) FILTER (status IN ('failed', 'final_failed')) AS DOUBLE) AS failed_per_min
      FROM tasks WHERE finished_at > {_NOW} - INTERVAL 7 DAY"""),
    "active_by_queue": _sql("jobs tasks", f"""SELECT b.queue, b.status, CAST(coalesce(c.n, 0) AS DOUBLE) AS count FROM
      (SELECT queue, status FROM (VALUES ('normal'), ('retry'), ('scheduled')) x(queue), (VALUES ('pending'), ('running')) y(status)) b
      LEFT JOIN (SELECT {_QUEUE} AS queue, status, count(*) AS n FROM tasks JOIN jobs USING (job_id)
        WHERE status IN ('pending', 'running') GROUP BY 1, 2) c ON c.queue = b.queue AND c.status = b.status"""),
    "ready_at": _sql("upstream", "SELECT downstream_job_id, max(completed_at) AS ready_at FROM upstream WHERE status IS NOT NULL GROUP BY 1"),
    "queue_depth_total": _sql("depths", """SELECT ts, depth,
      CASE WHEN depth >= 10000 THEN 'red' WHEN depth >= 1000 THEN 'orange' ELSE 'green' END AS band FROM depths"""),
    "series_summary": _sql("samples", """SELECT series, arg_max(value, (ts, value)) AS last, max(value) AS max FROM samples GROUP BY series"""),
    "retry_accounting": _sql("jobs tasks", """SELECT job_id, count(*) AS attempts,
      count(*) FILTER (status IN ('failed', 'final_failed')) AS failed_attempts,
      count(*) FILTER (status = 'final_failed') AS given_up,
      count(*) FILTER (status = 'final_failed') * (max_retries + 1) AS expected_failures
      FROM tasks JOIN jobs USING (job_id) GROUP BY job_id, max_retries"""),
    "dispatch_accounting": _sql("jobs tasks", """SELECT job_id, CAST(2 AS BIGINT) AS expected, coalesce(n, 0) AS actual, coalesce(n, 0) - 2 AS difference
      FROM jobs LEFT JOIN (SELECT job_id, count(*) AS n FROM tasks WHERE retry_count = 0 GROUP BY 1) USING (job_id)"""),
    "sum_by_label": _sql("samples", """SELECT series, sum(value) AS value FROM samples
      WHERE regexp_full_match(series, 'c.+|.*r.*') GROUP BY series"""),
    # Windows
    "latest_run_per_job": _sql("latest", "SELECT job_id, task_id, status, created_at FROM latest"),
    "counter_increase": _sql("steps", """SELECT series, ts, value,
      CAST(sum(step) OVER (PARTITION BY series ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS DOUBLE) AS increase FROM steps"""),
    "counter_rate": _sql("steps", """SELECT series, ts, value,
      round(CAST(sum(step) OVER (PARTITION BY series ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS DOUBLE) / 86400 * 100, 9) AS rate FROM steps"""),
    "status_transitions": _sql("observed", """SELECT task_id, ts, seq, status, previous,
      (epoch_us(ts) - epoch_us(first_ts)) / 1000000 AS elapsed_s FROM observed WHERE status IS DISTINCT FROM previous"""),
    "cumulative_counts": _sql("tasks", """SELECT bucket, CAST(sum(c) OVER w AS BIGINT) AS created, CAST(sum(s) OVER w AS BIGINT) AS succeeded, CAST(sum(f) OVER w AS BIGINT) AS failed
      FROM (SELECT date_trunc('minute', ts) AS bucket, sum(c) AS c, sum(s) AS s, sum(f) AS f FROM (
        SELECT created_at AS ts, 1 AS c, 0 AS s, 0 AS f FROM tasks UNION ALL
        SELECT finished_at, 0, CASE WHEN status = 'success' THEN 1 ELSE 0 END, CASE WHEN status = 'success' THEN 0 ELSE 1 END
        FROM tasks WHERE finished_at IS NOT NULL) GROUP BY 1)
      WINDOW w AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING)"""),
    "first_claim_per_task": _sql("winners", "SELECT task_id, worker_id, seq, attempted_at FROM winners"),
    "latest_version_per_job": _sql("changes", """SELECT job_id, job_type, enabled, next_fire_at, updated_at FROM
      (SELECT *, max(updated_at) OVER (PARTITION BY job_id) AS last FROM changes) WHERE updated_at = last"""),
    # Graph
    "descendants": _sql("jobs cyclic", """WITH sub AS (
      SELECT downstream_job_id AS job_id FROM cyclic WHERE upstream_job_id IN (SELECT job_id FROM jobs WHERE enabled AND action_type = 'http')
      UNION SELECT e.downstream_job_id FROM sub s JOIN cyclic e ON e.upstream_job_id = s.job_id)
      SELECT job_id FROM sub"""),
    "closure": _sql("cyclic", "WITH " + _REACH.format(edges="cyclic") + " SELECT a AS ancestor, d AS descendant FROM reach"),
    "jobs_on_cycle": _sql("cyclic", "WITH " + _REACH.format(edges="cyclic") + " SELECT a AS job_id FROM reach WHERE a = d"),
    "has_cycle": _sql("edges cyclic", "WITH " + _REACH.format(edges="cyclic") + """,
      plain AS (SELECT upstream_job_id AS a, downstream_job_id AS d FROM edges UNION
        SELECT r.a, e.downstream_job_id FROM plain r JOIN edges e ON e.upstream_job_id = r.d)
      SELECT 'acyclic' AS name, EXISTS (SELECT 1 FROM plain WHERE a = d) AS has_cycle
      UNION ALL SELECT 'cyclic', EXISTS (SELECT 1 FROM reach WHERE a = d)"""),
    "validate_edges": _sql("proposed", "WITH " + _REACH.format(edges="proposed") + """
      SELECT DISTINCT job_id, NOT EXISTS (SELECT 1 FROM reach WHERE a = d AND a = job_id) AS accepted FROM proposals"""),
    "chain_descendants": "SELECT c_custkey AS job_id FROM customer WHERE c_custkey > 7",
    "chain_cycles": "SELECT 'chain' AS name, count(*) FILTER (c_custkey - 1 >= c_custkey) AS n FROM customer UNION ALL SELECT 'ring', count(*) FROM customer WHERE c_custkey BETWEEN 1 AND 10",
    "neighbourhood_nodes": _sql("jobs cyclic", """SELECT n.job_id, n.kind, j.name FROM (
      SELECT upstream_job_id AS job_id, 'upstream' AS kind FROM cyclic WHERE downstream_job_id = 15
      UNION SELECT downstream_job_id, 'downstream' FROM cyclic WHERE upstream_job_id = 15
      UNION SELECT 15, 'current') n LEFT JOIN jobs j ON j.job_id = n.job_id"""),
    "neighbourhood_edges": _sql("cyclic", "SELECT DISTINCT upstream_job_id, downstream_job_id FROM cyclic WHERE upstream_job_id = 15 OR downstream_job_id = 15"),
    "candidate_set": _sql("below", """SELECT job_id FROM below UNION
      SELECT upstream_job_id FROM edges WHERE downstream_job_id IN (SELECT job_id FROM below)"""),
    # Schedules and dispatch
    "classify_schedule": _sql("faulty next", """SELECT job_id,
      CASE WHEN f.cron_expression IS NULL THEN 'normal' WHEN f.job_id % 7 NOT IN (3, 4) THEN 'scheduled' END AS job_type,
      f.cron_expression, CASE f.job_id % 7 WHEN 5 THEN TIMESTAMP '2001-08-03 00:00:00' WHEN 6 THEN TIMESTAMP '2001-08-31 02:00:00' ELSE n.fires_at END AS next_fire_at,
      CASE WHEN f.job_id % 7 IN (3, 4) THEN 'Invalid cron expression' END AS error
      FROM faulty f LEFT JOIN nxt n ON n.cron_expression = f.cron_expression"""),
    "next_fire": _sql("jobs next", """SELECT job_id, j.cron_expression, n.fires_at
      FROM jobs j LEFT JOIN nxt n ON n.cron_expression = j.cron_expression"""),
    "valid_cron": _sql("faulty", "SELECT job_id, job_id % 7 NOT IN (3, 4) AND cron_expression IS NOT NULL AS valid FROM faulty"),
    "fire_calendar": _sql("jobs firings", """SELECT job_id, m AS fire_at FROM jobs JOIN firings USING (cron_expression)
      WHERE m > TIMESTAMP '2001-08-01 18:00:00' AND m <= TIMESTAMP '2001-08-02 06:30:00'"""),
    "dispatch_audit": _sql("jobs tasks firings", """SELECT job_id,
      (SELECT count(*) FROM firings f WHERE f.cron_expression = j.cron_expression AND m > TIMESTAMP '2001-07-01 00:00:00' AND m <= TIMESTAMP '2001-08-01 00:00:00') AS planned,
      (SELECT count(*) FROM tasks t WHERE t.job_id = j.job_id AND trigger_type = 'scheduled' AND retry_count = 0
        AND created_at > TIMESTAMP '2001-07-01 00:00:00' AND created_at <= TIMESTAMP '2001-08-01 00:00:00') AS actual
      FROM jobs j WHERE cron_expression IS NOT NULL"""),
    "missed_firings": _sql("jobs tasks firings", """, planned AS (SELECT job_id, m AS fire_at FROM jobs JOIN firings USING (cron_expression)
        WHERE m > TIMESTAMP '2001-07-28 00:00:00' AND m <= TIMESTAMP '2001-08-01 00:00:00'),
      started AS (SELECT job_id, task_id, created_at FROM tasks WHERE trigger_type = 'scheduled' AND retry_count = 0
        AND created_at > TIMESTAMP '2001-07-28 00:00:00' AND created_at <= TIMESTAMP '2001-08-01 00:00:00'),
      met AS (SELECT p.job_id, p.fire_at, arg_min(s.task_id, s.created_at) AS task_id
        FROM started s ASOF JOIN planned p ON s.job_id = p.job_id AND s.created_at >= p.fire_at GROUP BY 1, 2)
      SELECT job_id, fire_at, task_id FROM planned LEFT JOIN met USING (job_id, fire_at)"""),
    "dispatch_due_runs": _sql("due", f"SELECT job_id, {_new_run('scheduled', 'scheduled')} FROM due WHERE NOT blocked"),
    "dispatch_due_jobs": _sql("due next", "SELECT job_id, fires_at AS next_fire_at FROM due JOIN nxt USING (cron_expression)"),
    "concurrency_gate": _sql("due", "SELECT job_id, concurrency_policy, blocked FROM due"),
    "dispatch_one_time": _sql("jobs edges", f"""SELECT job_id, {_new_run('manual', 'normal')} FROM jobs
      WHERE job_type = 'normal' AND enabled AND job_id NOT IN (SELECT downstream_job_id FROM edges WHERE downstream_job_id % 20 NOT IN (3, 7))"""),
    "dispatch_on_enable": _sql("edited edges", f"""SELECT job_id, {_new_run('manual', 'normal')} FROM edited
      WHERE job_type = 'normal' AND enabled AND (NOT was_enabled OR job_id % 20 = 3) AND job_id NOT IN (SELECT downstream_job_id FROM edges WHERE downstream_job_id % 20 NOT IN (3, 7))"""),
    "trigger": _sql("jobs", """SELECT o_custkey AS job_id, CASE WHEN o_custkey IN (SELECT job_id FROM jobs) THEN 'normal' ELSE 'Job not found' END AS outcome FROM orders"""),
    "route": _sql("routed", "SELECT task_id, queue FROM routed"),
    "reconstruct_queue": _sql("jobs tasks", f"SELECT task_id, {_QUEUE} AS queue FROM tasks JOIN jobs USING (job_id)"),
    "sync_snapshot": _sql("jobs changes", f""", recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC) AS rn
        FROM changes WHERE job_type = 'scheduled' AND updated_at >= {_NOW} - INTERVAL 10 SECOND) WHERE rn = 1)
      SELECT job_id, job_type, enabled, next_fire_at, updated_at FROM jobs
        WHERE enabled AND job_type = 'scheduled' AND job_id NOT IN (SELECT job_id FROM recent)
      UNION ALL SELECT job_id, job_type, enabled, next_fire_at, updated_at FROM recent WHERE enabled"""),
    "live_firings": _sql("jobs", f"""SELECT c_custkey AS job_id,
      {_NOW} + INTERVAL 1 SECOND * ((c_custkey % 121) - 60) + INTERVAL 500 MICROSECOND * (c_custkey % 4) AS fire_at,
      c_custkey % 4 <= 2 AND c_custkey IN (SELECT job_id FROM jobs WHERE enabled AND job_type = 'scheduled') AS live
      FROM customer WHERE c_custkey % 5 < 3"""),
    "new_plans": _sql("jobs", """SELECT job_id, next_fire_at + INTERVAL 1 MINUTE AS fire_at FROM jobs
      WHERE job_type = 'scheduled' AND enabled AND job_id % 13 <> 0"""),
    # Runs
    "manual_retry": _sql("tasks", """, asked AS (SELECT DISTINCT l_orderkey + l_linenumber * 3 AS task_id FROM lineitem)
      SELECT job_id || '/' || trigger_type || '/' || (retry_count + 1) || '/retry' AS what, count(*) AS count
        FROM asked JOIN tasks USING (task_id) WHERE status IN ('failed', 'final_failed') GROUP BY 1
      UNION ALL SELECT task_id || '/' || CASE WHEN status IS NULL THEN 'Task not found' ELSE 'Only failed tasks can be retried' END, 1
        FROM asked LEFT JOIN tasks USING (task_id) WHERE status IS NULL OR status NOT IN ('failed', 'final_failed')"""),
    "apply_results": _sql("judged", f"""SELECT task_id, job_id, status, CASE WHEN gone THEN 'Job not found' ELSE stderr END AS stderr,
      {_NOW} AS finished_at, length(cut) AS stdout_chars, md5(cut) AS stdout_md5
      FROM (SELECT *, CASE WHEN gone THEN '' WHEN length(stdout) > 64000 THEN substring(stdout, 1, 64000) || chr(10) || '...[truncated]' ELSE stdout END AS cut FROM judged)"""),
    "result_retries": _sql("judged", f"""SELECT job_id, 'pending' AS status, trigger_type, retry_count + 1 AS retry_count, {_NOW} AS created_at, 'retry' AS queue
      FROM judged WHERE status = 'failed'"""),
    "claim": _sql("tasks winners", f"""SELECT t.task_id, t.job_id, 'running' AS status, w.worker_id AS locked_by,
      {_NOW} + INTERVAL 30 SECOND AS locked_until, {_NOW} AS started_at
      FROM tasks t JOIN winners w ON w.task_id = t.task_id WHERE t.status = 'pending'"""),
    "claim_loss_action": _sql("tasks winners", """SELECT a.task_id, a.worker_id, a.seq, a.attempted_at,
      CASE WHEN t.status IS NULL OR t.status IN ('success', 'failed', 'final_failed') THEN 'delete' ELSE 'keep' END AS action
      FROM attempts a LEFT JOIN tasks t ON t.task_id = a.task_id LEFT JOIN winners w ON w.task_id = a.task_id
      WHERE NOT coalesce(t.status = 'pending' AND w.worker_id = a.worker_id AND w.seq = a.seq AND w.attempted_at = a.attempted_at, false)"""),
    "recover_orphans": _sql("tasks", f"""SELECT task_id, job_id, 'pending' AS status, CAST(NULL AS VARCHAR) AS locked_by, retry_count
      FROM tasks WHERE status = 'running' AND locked_until < {_NOW}"""),
    "lease_extension": _sql("tasks", f"""SELECT task_id, locked_by, {_NOW} - INTERVAL 1 SECOND * (task_id % 50) + INTERVAL 4 HOUR AS locked_until
      FROM tasks WHERE status = 'running' AND task_id % 3 <> 0"""),
    "ready_jobs": _sql("ready", "SELECT job_id, ready_at FROM ready"),
    "ready_now": _sql("guarded", "SELECT job_id, ready_at FROM guarded"),
    "generation_guard": _sql("jobs latest", """SELECT j.job_id, j.created_at AS ready_at FROM jobs j LEFT JOIN latest l ON l.job_id = j.job_id
      WHERE l.job_id IS NULL OR coalesce(l.finished_at, l.created_at) < j.created_at"""),
    "dispatch_dependents": _sql("guarded below", f"SELECT job_id, {_new_run('dependency', 'normal')} FROM guarded WHERE job_id IN (SELECT job_id FROM below)"),
    "marked_successes": _sql("unchained", "SELECT task_id, true AS processed_for_chaining FROM unchained"),
    "blocked_report": _sql("upstream below", """SELECT downstream_job_id, upstream_job_id, coalesce(status, 'never run') AS upstream_status
      FROM upstream WHERE downstream_job_id IN (SELECT job_id FROM below) AND status IS DISTINCT FROM 'success'"""),
    "scheduler_pass_runs": _sql("pass_due pass_latest below", f""", state AS (SELECT e.downstream_job_id AS job_id,
        bool_and(coalesce(l.status = 'success', false)) AS ok, max(coalesce(l.finished_at, l.created_at)) AS ready_at
        FROM edges e LEFT JOIN pass_latest l ON l.job_id = e.upstream_job_id GROUP BY 1)
      SELECT job_id, {_new_run('scheduled', 'scheduled')} FROM pass_due
      UNION ALL SELECT s.job_id, {_new_run('dependency', 'normal')} FROM state s LEFT JOIN pass_latest own ON own.job_id = s.job_id
        WHERE ok AND s.job_id IN (SELECT job_id FROM below)
          AND (own.job_id IS NULL OR coalesce(own.finished_at, own.created_at) < s.ready_at)"""),
    "scheduler_pass_tasks": _sql("unchained", f"""SELECT task_id, status, true AS processed_for_chaining FROM unchained
      UNION ALL SELECT task_id, 'pending', processed_for_chaining FROM tasks WHERE status = 'running' AND locked_until < {_NOW}"""),
    "truncate_output": """SELECT task_id, length(cut) AS chars, md5(cut) AS md5 FROM (SELECT doc_id AS task_id,
      CASE WHEN length(text) > 64000 THEN substring(text, 1, 64000) || chr(10) || '...[truncated]' ELSE text END AS cut FROM documents)""",
    # Queues and fleet
    "queue_depth_timeline": _sql("messages", """SELECT queue, bucket, CAST(sum(v) OVER w AS BIGINT) AS visible, CAST(sum(f) OVER w AS BIGINT) AS not_visible
      FROM (SELECT queue, date_trunc('minute', ts) AS bucket,
        sum(CASE op WHEN 'send' THEN 1 WHEN 'receive' THEN -1 ELSE 0 END) AS v,
        sum(CASE op WHEN 'receive' THEN 1 WHEN 'delete' THEN -1 ELSE 0 END) AS f FROM messages GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY queue ORDER BY bucket ROWS UNBOUNDED PRECEDING)"""),
    "fleet_size": _sql("depths", """SELECT ts, depth, needed, desired, CASE WHEN desired >= 10 THEN 'red' WHEN desired >= 7 THEN 'orange' WHEN desired >= 2 THEN 'green' ELSE 'blue' END AS band
      FROM (SELECT ts, depth, CAST(ceil(depth / 20) AS BIGINT) AS needed, CAST(greatest(1, least(10, ceil(depth / 20))) AS BIGINT) AS desired FROM depths)"""),
    "queue_replicas": _sql("gauges", """SELECT queue, ts, CAST(coalesce(visible, 0) AS BIGINT) AS visible,
      CAST(greatest(1, least(3, ceil(coalesce(visible, 0) / 20))) AS BIGINT) AS replicas FROM gauges"""),
    "scale_action": _sql("depths", """SELECT ts, desired, current, CASE WHEN desired > current THEN 'create' WHEN desired < current THEN 'terminate' ELSE 'none' END AS action,
      abs(desired - current) AS amount,
      CASE WHEN abs(desired - current) >= 9 THEN 'red' WHEN abs(desired - current) >= 5 THEN 'orange' ELSE 'green' END AS extra_band
      FROM (SELECT ts, CAST(greatest(1, least(10, ceil(depth / 2))) AS BIGINT) AS desired, day(ts) % 10 + 1 AS current FROM depths)"""),
    # Definitions
    "runtime_spec": _sql("jobs", f"""SELECT job_id, CASE WHEN c_nationkey % 2 = 0 THEN 'curlimages/curl:8.6.0' ELSE 'alpine:3' END AS image,
      {_RUNTIME} AS command, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey + 1 ELSE 30 END AS timeout_seconds FROM jobs"""),
    "rederive_spec": _sql("jobs", """SELECT job_id, 'curlimages/curl:8.6.0' AS image,
      'curl|-fsS|-X|GET|-H|A: 1|-H|B: 2|-d|{"k": [1, 2], "t": "a, b: c"}|https://new.example/' || CAST(job_id AS VARCHAR) AS command,
      '500m' AS cpu, '256Mi' AS memory FROM jobs WHERE job_id % 4 = 0"""),
    "invalid_jobs": _sql("faulty", _INVALID),
    # Streams
    "message_actions": _sql("tasks", """SELECT o_orderkey AS seq, id AS task_id,
      CASE WHEN id IS NULL THEN 'drop' WHEN o_orderkey % 8 = 3 OR status NOT IN ('pending', 'running') THEN 'delete'
           WHEN status = 'pending' THEN 'run' ELSE 'keep' END AS action
      FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 3 THEN 't-' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 8 = 3 THEN CAST(o_orderkey AS VARCHAR) END AS id FROM orders)
      JOIN tasks ON task_id = o_orderkey"""),
    "dedup_messages": "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS task_id FROM lineitem",
    "throughput_stream": _sql("tasks", """SELECT date_trunc('minute', finished_at) AS window_start, date_trunc('minute', finished_at) + INTERVAL 1 MINUTE AS window_end,
      count(*) FILTER (status = 'success') AS success, count(*) FILTER (status IN ('failed', 'final_failed')) AS failed
      FROM tasks WHERE finished_at IS NOT NULL GROUP BY 1, 2"""),
    "lease_monitor": """WITH e AS (SELECT user_id AS task_id, 'worker-' || CAST(user_id % 8 AS VARCHAR) AS worker_id, ts,
        CASE WHEN event_id % 3 = 0 THEN 'claim' WHEN event_id % 7 = 0 THEN 'finish' ELSE 'beat' END AS kind FROM events),
      starts AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY task_id ORDER BY ts) + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
      numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts) AS n FROM starts),
      sessions AS (SELECT task_id, worker_id, n, max(ts) AS last, max(ts) FILTER (kind = 'claim') AS claimed,
        max(ts) FILTER (kind = 'finish') AS finished, max(ts) FILTER (kind <> 'finish') AS beat FROM numbered GROUP BY ALL)
      SELECT task_id, worker_id, beat + INTERVAL 4 HOUR AS locked_until FROM sessions
      WHERE claimed IS NOT NULL AND (finished IS NULL OR finished < claimed)
        """,
    "job_changes_stream": _sql("changes", """SELECT job_id, job_type, enabled, next_fire_at, updated_at FROM
      (SELECT *, max(updated_at) OVER (PARTITION BY job_id) AS last FROM changes) WHERE updated_at = last AND enabled AND job_type = 'scheduled'"""),
}
_WORK = """, sent AS (SELECT CASE WHEN l_linenumber = 3 THEN '{"id": 1}' WHEN l_linenumber = 2 THEN CAST(l_orderkey AS VARCHAR)
    ELSE '{"task_id": "' || CAST(l_orderkey AS VARCHAR) || '"}' END AS body, CASE WHEN l_linenumber NOT IN (2, 3) THEN l_orderkey END AS task_id,
    'worker-' || CAST(l_suppkey AS VARCHAR) AS worker_id, l_linenumber AS seq, l_shipdate AS ts FROM lineitem),
  ranked AS (SELECT s.*, t.status, t.job_id, t.retry_count, row_number() OVER (PARTITION BY s.task_id ORDER BY ts, worker_id, seq) AS nth
    FROM sent s LEFT JOIN tasks t ON t.task_id = s.task_id),
  told AS (SELECT r.*, j.job_id IS NULL AS gone, d.doc_id IS NOT NULL AS ended, d.doc_id % 2 = 1 AS success, j.max_retries,
      r.status = 'pending' AND nth = 1 AS won
    FROM ranked r LEFT JOIN jobs j ON j.job_id = r.job_id LEFT JOIN documents d ON d.doc_id = r.task_id)"""
ORACLE["worker_pass_messages"] = _sql("jobs tasks", _WORK + """ SELECT body, worker_id, seq, ts, CASE WHEN task_id IS NULL OR status IS NULL THEN 'delete'
    WHEN won THEN CASE WHEN ended OR gone THEN 'delete' ELSE 'keep' END WHEN status IN ('pending', 'running') THEN 'keep' ELSE 'delete' END AS action FROM told""")
ORACLE["worker_pass_runs"] = _sql("jobs tasks", _WORK + """ SELECT task_id, CASE WHEN gone THEN 'final_failed' WHEN NOT ended THEN 'running' WHEN success THEN 'success'
    WHEN retry_count >= max_retries THEN 'final_failed' ELSE 'failed' END AS status, CASE WHEN NOT ended AND NOT gone THEN worker_id END AS locked_by FROM told WHERE won""")
ORACLE["lease_orphans_stream"] = ORACLE["lease_monitor"]
ORACLE["throughput_sliding_stream"] = _sql("tasks", """SELECT ws AS window_start, ws + INTERVAL 1 MINUTE AS window_end,
  count(*) FILTER (status = 'success') AS success, count(*) FILTER (status IN ('failed', 'final_failed')) AS failed
  FROM (SELECT status, unnest(range(time_bucket(INTERVAL 5 SECOND, finished_at) - INTERVAL 55 SECOND, finished_at + INTERVAL 1 MICROSECOND, INTERVAL 5 SECOND)) AS ws
    FROM tasks WHERE finished_at IS NOT NULL) GROUP BY ws""")
ORACLE["chain_stream"] = ORACLE["dispatch_dependents"]
ORACLE["transitions_stream"] = ORACLE["status_transitions"]
