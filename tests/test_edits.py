"""Creating and changing job definitions, and the rules for them."""

from datetime import datetime

from jobruns.operators import definitions, edits
from tests.conftest import values

NOW = "2024-01-01 00:00:00"
JOB = (
    "job_id long, name string, job_type string, cron_expression string, action_type string, action_config string, "
    "enabled boolean, concurrency_policy string, max_retries int, next_fire_at time, created_at time, updated_at time"
)
SHELL = '{"command":"c"}'


def job(i, cron=None, enabled=True, name=None):
    kind = "scheduled" if cron else "normal"
    fire = "2024-01-01 01:00:00" if cron else None
    return (i, name or f"j{i}", kind, cron, "shell", SHELL, enabled, "allow", 0, fire, NOW, NOW)


def test_updates(table):
    jobs = table(JOB, job(1, "0 1 * * *"), job(2), job(3, enabled=False), job(4, enabled=False), job(5, "0 1 * * *"), job(6))
    edges = table("upstream_job_id long, downstream_job_id long", (1, 4))
    changes = table(
        "job_id long, fields array<string>, name string, cron_expression string, enabled boolean, updated_at time",
        (1, ["cron_expression"], "ignored", None, None, "2024-01-02 00:00:00"),
        (1, ["name"], "early", "ignored", None, "2024-01-02 00:00:00"),
        (1, ["name"], "late", None, None, "2024-01-03 00:00:00"),
        (2, ["cron_expression"], None, " 30 0 * * * ", None, "2024-01-02 00:00:00"),
        (3, ["enabled"], None, None, True, "2024-01-02 00:00:00"),
        (4, ["enabled"], None, None, True, "2024-01-02 00:00:00"),
        (5, ["cron_expression", "name"], "never", "nonsense", None, "2024-01-02 00:00:00"),
        (9, ["name"], "unknown", None, None, "2024-01-02 00:00:00"),
    )
    edit = edits.update_jobs(jobs, changes, edges, NOW)
    got = {r.job_id: (r.name, r.job_type, r.cron_expression, r.next_fire_at, r.enabled) for r in edit.jobs.collect()}
    one, half = datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 0, 30)
    assert got == {
        1: ("late", "normal", None, None, True), 2: ("j2", "scheduled", "30 0 * * *", half, True), 3: ("j3", "normal", None, None, True),
        4: ("j4", "normal", None, None, True), 5: ("j5", "scheduled", "0 1 * * *", one, True), 6: ("j6", "normal", None, None, True),
    }
    assert values(edit.new_runs, "job_id", "trigger_type", "queue") == [(3, "manual", "normal")]
    assert values(edit.refused) == [(5, "Invalid cron expression"), (9, "Job not found")]
    assert edit.jobs.where("job_type = 'scheduled' AND cron_expression IS NULL").count() == 0


def test_creation(table):
    jobs = table(JOB, job(1))
    new = table(
        "job_id long, name string, cron_expression string, action_type string, action_config string, enabled boolean, concurrency_policy string, max_retries int",
        (2, "hourly", "@hourly", "shell", SHELL, True, "allow", 0), (3, "once", " ", "shell", SHELL, True, "allow", 0),
        (4, "waits", None, "shell", SHELL, True, "allow", 0), (5, "off", None, "shell", SHELL, False, "allow", 0),
        (6, "bad", "x", "http", "{}", True, "allow", 0), (1, "taken", None, "shell", SHELL, True, "allow", 0),
    )
    edges = table("upstream_job_id long, downstream_job_id long", (1, 4))
    edit = edits.create_jobs(jobs, new, edges, NOW)
    assert values(edit.jobs, "job_id", "job_type", "next_fire_at") == [
        (1, "normal", None), (2, "scheduled", datetime(2024, 1, 1, 1)), (3, "normal", None), (4, "normal", None), (5, "normal", None),
    ]
    assert values(edit.new_runs, "job_id") == [(3,)]
    assert values(edit.refused) == [(1, "id is taken"), (6, "Invalid cron expression"), (6, "missing url")]


def test_creation_sends_no_jobs_through_the_driver(table):
    new = table(JOB, job(2), job(3, name="j2"))
    edit = edits.create_jobs(table(JOB, job(1)), new, table("upstream_job_id long, downstream_job_id long", (1, 2)), NOW)
    for frame in (edit.jobs, edit.new_runs, edit.edges):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
        assert all("[cron_expression" in line for line in joins), joins


def test_configurations(table):
    configs = {
        '{"url":"u"}': [], '{"url":"u","timeout_seconds":"5"}': [], '{"url":"u","timeout_seconds":5.0}': [], '{"url":"u","timeout_seconds":true}': [],
        '{"url":"u","body":null,"headers":{"a":"b"}}': [], '{"url":"u","timeout_seconds":null}': ["timeout_seconds below 1"],
        '{"url":"u","timeout_seconds":1.5}': ["timeout_seconds below 1"], '{"url":"u","timeout_seconds":"0"}': ["timeout_seconds below 1"],
        '{"url":"u","headers":null}': ["headers are not an object of strings"], '{"url":"u","headers":{"a":1}}': ["headers are not an object of strings"],
        '{"url":"u","method":null}': ["method is not text"], '{"url":5}': ["missing url"], '{"url":null}': ["missing url"],
        '["url"]': ["action_config is no JSON object", "missing url"], "{": ["action_config is no JSON object", "missing url"],
    }
    rows = [(i, f"n{i}", None, "http", c, True, "allow", 0) for i, c in enumerate(configs)]
    jobs = table("job_id long, name string, cron_expression string, action_type string, action_config string, enabled boolean, concurrency_policy string, max_retries int", *rows)
    found = {c: [] for c in configs}
    for i, reason in values(definitions.invalid_jobs(jobs)):
        found[list(configs)[i]].append(reason)
    assert found == configs


def test_requests_are_refused_whole(table):
    """One case each: circle, taken name, value that breaks a rule, null fields; and what is left is applied."""
    jobs = table(JOB, *[job(i, name=f"j{i}") for i in range(1, 9)])
    edges = table("upstream_job_id long, downstream_job_id long", (1, 2), (2, 3))
    at = "2024-01-02 00:00:0"
    changes = table(
        "job_id long, fields array<string>, name string, max_retries int, action_config string, updated_at time",
        (1, ["name"], "first", None, None, at + "1"), (2, ["name"], "j5", None, None, at + "1"), (3, ["max_retries"], None, -3, None, at + "1"),
        (4, None, "lost", None, None, at + "1"), (5, ["action_config"], None, None, "{}", at + "1"), (6, ["name"], "same", None, None, at + "2"),
        (7, ["name"], "same", None, None, at + "1"), (8, ["name"], None, None, None, at + "1"),
    )
    lists = table(
        "job_id long, updated_at time, side string, other_job_id long",
        (1, at + "1", "upstream", 3), (3, at + "2", "upstream", 7), (3, at + "2", "upstream", 99), (2, at + "3", "downstream", None), (77, at + "1", "upstream", 1),
    )
    edit = edits.update_jobs(jobs, changes, edges, NOW, lists)
    assert values(edit.refused) == [
        (1, "Circular dependency detected"), (2, "duplicate name"), (3, "negative max_retries"), (4, "fields is null"), (5, "missing command"),
        (6, "duplicate name"), (77, "Job not found"), (8, "name is null"),
    ]
    assert values(edit.jobs.where("updated_at > created_at"), "job_id", "name") == [(7, "same")]
    assert values(edit.edges) == [(1, 2), (7, 3)]


def test_specifications_move_only_with_action_and_configuration(table):
    from pyspark.sql import functions as F

    stored = F.struct(F.lit("old").alias("image"), F.array(F.lit("x")).alias("command"), F.create_map().cast("map<string,string>").alias("env"), F.lit(1).alias("timeout_seconds"))
    jobs = table(JOB, job(1), job(2)).withColumn("runtime_spec", stored)
    changes = table(
        "job_id long, fields array<string>, name string, action_config string, updated_at time",
        (1, ["action_config"], None, '{"command":"new"}', "2024-01-02 00:00:00"), (2, ["name"], "renamed", None, "2024-01-02 00:00:00"),
    )
    edit = edits.update_jobs(jobs, changes, table("upstream_job_id long, downstream_job_id long"), NOW)
    assert {r.job_id: r.runtime_spec.command for r in edit.jobs.collect()} == {1: ["sh", "-c", "new"], 2: ["x"]}


def test_new_jobs_on_a_circle_or_with_a_taken_name(table):
    jobs = table(JOB, job(1))
    new = table(
        "job_id long, name string, cron_expression string, action_type string, action_config string, enabled boolean, concurrency_policy string, max_retries int",
        *[(i, n, None, "shell", SHELL, True, "allow", 0) for i, n in ((2, "itself"), (3, "j1"), (4, "fine"), (5, "below"))],
    )
    edges = table("upstream_job_id long, downstream_job_id long", (2, 2), (1, 3), (4, 5))
    edit = edits.create_jobs(jobs, new, edges, NOW)
    assert values(edit.refused) == [(2, "Circular dependency detected"), (3, "duplicate name")]
    assert values(edit.jobs, "job_id") == [(1,), (4,), (5,)] and values(edit.edges) == [(4, 5)]
    assert values(edit.new_runs, "job_id") == [(4,)]
