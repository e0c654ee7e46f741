"""Dispatch, claims, outcomes, recovery and dependencies on small hand-made tables."""

from datetime import datetime

import pytest

from jobruns.operators import runs, schedule, select, windows
from jobruns.plans.scheduler_pass import scheduler_pass
from jobruns.sources.tables import Tables
from tests.conftest import values

NOW = "2024-05-01 12:00:00"
JOB = "job_id long, name string, job_type string, cron_expression string, enabled boolean, concurrency_policy string, max_retries int, next_fire_at time, created_at time, updated_at time"
TASK = "task_id long, job_id long, status string, trigger_type string, retry_count int, locked_by string, locked_until time, started_at time, created_at time, finished_at time, processed_for_chaining boolean"
EDGE = "upstream_job_id long, downstream_job_id long"


def job(i, policy="allow", fire="2024-05-01 11:59:59", enabled=True, kind="scheduled", retries=0, cron="* * * * *"):
    scheduled = kind == "scheduled"
    return (i, f"job-{i}", kind, cron if scheduled else None, enabled, policy, retries, fire if scheduled else None, NOW, NOW)


def task(i, j, status, created="2024-05-01 10:00:00", finished=None, until=None, retry=0, trigger="manual", done=False):
    return (i, j, status, trigger, retry, "w" if status == "running" else None, until, None, created, finished, done)


@pytest.fixture(scope="module")
def make(table):
    return lambda jobs=(), tasks=(), edges=(): Tables(table(JOB, *jobs), table(TASK, *tasks), table(EDGE, *edges))


def test_lock_boundary(make):
    t = make(tasks=[
        task(1, 1, "running", until="2024-05-01 11:59:59"), task(2, 1, "running", until="2024-05-01 12:00:01"),
        task(3, 1, "success", until="2024-04-30 12:00:00"), task(4, 1, "running", until=NOW), task(5, 1, "running"),
    ])
    assert values(select.expired_running(t.tasks, NOW), "task_id") == [(1,)]
    assert values(runs.recover_orphans(t.tasks, NOW), "task_id", "status", "locked_by", "locked_until", "started_at", "retry_count") == [
        (1, "pending", None, None, None, 0)
    ]


def test_due_and_armed_share_the_exact_moment(make):
    t = make([job(1, fire=NOW), job(2, fire="2024-05-01 12:00:01"), job(3, enabled=False), job(4, kind="normal")])
    assert values(select.due_jobs(t.jobs, NOW), "job_id") == [(1,)]
    assert select.armed_jobs(t.jobs, NOW).first().armed == 2.0


def test_forbid_blocks_only_while_running_and_the_job_moves_on(make):
    t = make(
        [job(1, "forbid"), job(2, "forbid"), job(3, "replace"), job(4, "allow"), job(5, "Allow")],
        [task(1, 1, "running"), task(2, 2, "pending"), task(3, 3, "running"), task(4, 4, "running"), task(5, 5, "running")],
    )
    out = schedule.dispatch_due(t.jobs, t.tasks, NOW)
    assert values(out.new_runs, "job_id", "trigger_type", "retry_count", "queue") == [
        (i, "scheduled", 0, "scheduled") for i in (2, 3, 4, 5)
    ]
    assert {(r.job_id, r.next_fire_at) for r in out.changed_jobs.collect()} == {
        (i, datetime(2024, 5, 1, 12, 1)) for i in range(1, 6)
    }


def test_missed_firings_collapse(make):
    t = make([job(1, fire="2024-04-29 00:00:00")])
    assert schedule.dispatch_due(t.jobs, t.tasks, NOW).new_runs.count() == 1


def test_one_time_jobs(make):
    t = make([job(1, kind="normal"), job(2, kind="normal"), job(3, kind="normal", enabled=False), job(4)], edges=[(1, 2)])
    assert values(schedule.dispatch_one_time(t.jobs, t.edges, NOW), "job_id", "trigger_type", "queue") == [(1, "manual", "normal")]
    on = make([job(1, kind="normal"), job(2, kind="normal"), job(3, kind="normal"), job(4)])
    assert values(schedule.dispatch_on_enable(t.jobs, on.jobs, t.edges, NOW), "job_id") == [(3,)]


def test_trigger_ignores_enabled_and_policy(make, table):
    t = make([job(1, "forbid", enabled=False)], [task(1, 1, "running")])
    out = schedule.trigger(table("job_id long, request_id long", (1, 1), (1, 2), (9, 3)), t.jobs, NOW)
    assert out.new_runs.select("task_id").distinct().count() == 2
    assert values(out.refused, "job_id", "reason") == [(9, "Job not found")]


def test_manual_retry(make, table):
    t = make(tasks=[task(1, 7, "failed", retry=5, trigger="scheduled"), task(2, 7, "final_failed"), task(3, 7, "success")])
    out = runs.manual_retry(table("task_id long", (1,), (2,), (3,), (4,)), t.tasks, NOW)
    assert values(out.new_runs, "job_id", "trigger_type", "retry_count", "queue") == [
        (7, "manual", 1, "retry"), (7, "scheduled", 6, "retry")
    ]
    assert values(out.refused) == [(3, "Only failed tasks can be retried"), (4, "Task not found")]


def test_outcomes_and_retries(make, table):
    t = make([job(1, retries=1)], [
        task(1, 1, "running"), task(2, 1, "running", trigger="dependency"), task(3, 1, "running", retry=1), task(4, 99, "running"),
    ])
    results = table(
        "task_id long, success boolean, stdout string, stderr string",
        (1, True, "x" * 12, None), (2, False, "ok", "e"), (3, False, None, "e"), (4, True, "lost", "lost"),
    )
    out = runs.apply_results(results, t.tasks, t.jobs, NOW, cap=10)
    assert values(out.finished, "task_id", "status", "stdout", "stderr", "locked_by") == [
        (1, "success", "x" * 10 + "\n...[truncated]", None, None),
        (2, "failed", "ok", "e", None),
        (3, "final_failed", None, "e", None),
        (4, "final_failed", "", "Job not found", None),
    ]
    assert values(out.retries, "job_id", "status", "trigger_type", "retry_count", "queue") == [(1, "pending", "dependency", 1, "retry")]


def test_captured_bytes_become_text(make, table):
    t = make([job(1)], [task(1, 1, "running")])
    results = table("task_id long, success boolean, stdout binary, stderr string", (1, True, bytearray(b"a\xffb"), None))
    assert values(runs.apply_results(results, t.tasks, t.jobs, NOW).finished, "stdout") == [("a\ufffdb",)]


def test_equal_requests_without_an_id_are_one(make, table):
    t = make([job(1)], [task(1, 1, "failed")])
    twice = table("job_id long", (1,), (1,))
    assert schedule.trigger(twice, t.jobs, NOW).new_runs.count() == 1
    retries = table("task_id long, request_id long", (1, 1), (1, 2))
    assert runs.manual_retry(retries, t.tasks, NOW).new_runs.select("task_id").distinct().count() == 2
    assert runs.manual_retry(retries.drop("request_id"), t.tasks, NOW).new_runs.count() == 1


def test_a_chain_takes_max_retries_plus_one_attempts(make, table):
    t = make([job(1, retries=3)])
    tasks = table(TASK, task(1, 1, "running"))
    attempts = 0
    while True:
        attempts += 1
        ids = [r.task_id for r in tasks.collect()]
        results = tasks.selectExpr("task_id", "false AS success", "'' AS stdout", "'' AS stderr")
        out = runs.apply_results(results, tasks, t.jobs, NOW)
        assert out.finished.count() == len(ids) == 1
        nxt = out.retries.collect()
        if not nxt:
            break
        tasks = table("task_id string, job_id long, trigger_type string, retry_count int", tuple(nxt[0][c] for c in ("task_id", "job_id", "trigger_type", "retry_count")))
    assert attempts == 4


def test_claim_has_one_winner_and_losers_keep_or_delete(make, table):
    t = make(tasks=[task(1, 1, "pending"), task(2, 1, "running"), task(3, 1, "failed")])
    attempts = table(
        "task_id long, worker_id string, seq int, attempted_at time",
        (1, "b", 1, "2024-05-01 11:00:01"), (1, "a", 1, "2024-05-01 11:00:01"), (1, "c", 1, "2024-05-01 11:00:02"),
        (2, "a", 1, "2024-05-01 11:00:00"), (3, "a", 1, "2024-05-01 11:00:00"), (4, "a", 1, "2024-05-01 11:00:00"),
    )
    got = runs.claim(attempts, t.tasks, NOW, 30).collect()
    assert [(r.task_id, r.status, r.locked_by, r.locked_until) for r in got] == [(1, "running", "a", datetime(2024, 5, 1, 12, 0, 30))]
    assert values(runs.claim_loss_action(attempts, t.tasks), "task_id", "worker_id", "action") == [
        (1, "b", "keep"), (1, "c", "keep"), (2, "a", "keep"), (3, "a", "delete"), (4, "a", "delete"),
    ]


def test_heartbeats_of_another_worker_do_not_count(make, table):
    t = make(tasks=[task(1, 1, "running", until=NOW), task(2, 1, "success")])
    beats = table("task_id long, worker_id string, ts time", (1, "w", NOW), (1, "x", "2024-05-01 13:00:00"), (2, "w", NOW))
    got = runs.lease_extension(beats, t.tasks, 30).collect()
    assert [(r.task_id, r.locked_until) for r in got] == [(1, datetime(2024, 5, 1, 12, 0, 30))]
    assert runs.heartbeat_interval(30) == 18 and runs.heartbeat_interval(1) == 1


def test_fan_in_waits_for_all_upstreams(make):
    jobs, edges = [job(1), job(2), job(3)], [(1, 3), (2, 3)]
    one = make(jobs, [task(1, 1, "success", finished="2024-05-01 10:01:00")], edges)
    assert runs.dispatch_dependents(one.tasks, one.jobs, one.edges, NOW).new_runs.count() == 0
    latest = windows.latest_state(one.tasks)
    report = runs.blocked_report(one.jobs.where("job_id = 3"), one.edges, latest)
    assert values(report) == [(3, 2, "never run")]
    both = make(jobs, [task(1, 1, "success", finished="2024-05-01 10:01:00"), task(2, 2, "success", finished="2024-05-01 10:02:00")], edges)
    out = runs.dispatch_dependents(both.tasks, both.jobs, both.edges, NOW)
    assert values(out.new_runs, "job_id", "trigger_type", "queue") == [(3, "dependency", "normal")]
    assert values(out.marked, "task_id", "processed_for_chaining") == [(1, True), (2, True)]


def test_a_newer_upstream_run_blocks(make):
    t = make([job(1), job(2)], [
        task(1, 1, "success", created="2024-05-01 09:00:00"), task(2, 1, "pending", created="2024-05-01 09:30:00"),
    ], [(1, 2)])
    assert runs.dispatch_dependents(t.tasks, t.jobs, t.edges, NOW).new_runs.count() == 0


def test_chain_fires_one_level_and_only_enabled_jobs(make):
    tasks = [task(1, 1, "success", finished="2024-05-01 10:01:00")]
    chain = make([job(1), job(2), job(3)], tasks, [(1, 2), (2, 3)])
    assert values(runs.dispatch_dependents(chain.tasks, chain.jobs, chain.edges, NOW).new_runs, "job_id") == [(2,)]
    off = make([job(1), job(2, enabled=False)], tasks, [(1, 2)])
    assert runs.dispatch_dependents(off.tasks, off.jobs, off.edges, NOW).new_runs.count() == 0


def test_generation_guard(make):
    ran_after = make([job(1), job(2)], [
        task(1, 1, "success", finished="2024-05-01 10:01:00"),
        task(2, 2, "success", created="2024-05-01 10:00:30", finished="2024-05-01 10:01:00", done=True),
    ], [(1, 2)])
    assert runs.dispatch_dependents(ran_after.tasks, ran_after.jobs, ran_after.edges, NOW).new_runs.count() == 0
    ran_before = make([job(1), job(2)], [
        task(1, 1, "success", finished="2024-05-01 10:01:00"), task(2, 2, "success", finished="2024-05-01 10:00:59", done=True),
    ], [(1, 2)])
    assert runs.dispatch_dependents(ran_before.tasks, ran_before.jobs, ran_before.edges, NOW).new_runs.count() == 1


def test_second_pass_at_the_same_time_does_nothing(make, spark):
    t = make([job(1), job(2), job(3)], [task(1, 2, "success", finished="2024-05-01 10:01:00")], [(2, 3)])
    t = t.with_(jobs=t.jobs.where("job_id <> 2 AND job_id <> 3").unionByName(
        make([job(2, fire="2024-05-01 13:00:00"), job(3, fire="2024-05-01 13:00:00")]).jobs))
    first = scheduler_pass(t, NOW)
    assert values(first.new_runs, "job_id", "trigger_type") == [(1, "scheduled"), (3, "dependency")]
    changed = first.changed_tasks.select("task_id")
    columns = ["task_id", "job_id", "status", "trigger_type", "retry_count", "created_at", "processed_for_chaining"]
    after = t.tasks.join(changed, "task_id", "left_anti").unionByName(first.changed_tasks.select(*t.tasks.columns))
    after = after.withColumn("task_id", after["task_id"].cast("string")).unionByName(
        first.new_runs.select(*columns), allowMissingColumns=True)
    jobs = t.jobs.join(first.changed_jobs, "job_id", "left_anti").unionByName(first.changed_jobs)
    second = scheduler_pass(Tables(jobs, after, t.edges), NOW)
    assert second.new_runs.count() == 0
    assert second.changed_tasks.count() == 0


def test_run_ids_repeat_with_their_inputs(make):
    t = make([job(1), job(2)])
    first = values(schedule.dispatch_due(t.jobs, t.tasks, NOW).new_runs, "task_id")
    assert first == values(schedule.dispatch_due(t.jobs, t.tasks, NOW).new_runs, "task_id")
    assert len(set(first)) == 2 and all(len(i[0]) == 36 for i in first)
    assert set(first).isdisjoint(values(schedule.dispatch_due(t.jobs, t.tasks, "2024-05-01 12:01:00").new_runs, "task_id"))


def test_snapshot_sync_is_repeatable(table):
    columns = "job_id long, job_type string, enabled boolean, next_fire_at time, updated_at time"
    before = table(columns, (1, "scheduled", True, NOW, NOW), (2, "scheduled", True, NOW, NOW))
    changes = table(
        columns,
        (1, "scheduled", False, NOW, "2024-05-01 12:00:05"), (3, "scheduled", True, NOW, "2024-05-01 12:00:01"),
        (3, "scheduled", True, "2024-05-01 13:00:00", "2024-05-01 12:00:02"), (4, "normal", True, None, "2024-05-01 12:00:02"),
        (2, "scheduled", False, NOW, "2024-05-01 11:00:00"),
    )
    once = schedule.sync_snapshot(before, changes, NOW)
    assert values(once, "job_id", "next_fire_at") == [(2, datetime(2024, 5, 1, 12)), (3, datetime(2024, 5, 1, 13))]
    assert values(schedule.sync_snapshot(once, changes, NOW)) == values(once)


def test_stale_firings(table):
    snapshot = table("job_id long, enabled boolean, next_fire_at time", (1, True, NOW), (2, True, NOW))
    planned = table("job_id long, fire_at time", (1, "2024-05-01 12:00:00.001"), (2, "2024-05-01 12:00:00.002"), (3, NOW))
    assert values(schedule.live_firings(planned, snapshot), "job_id", "live") == [(1, True), (2, False), (3, False)]
    moved = table("job_id long, enabled boolean, next_fire_at time", (1, True, "2024-05-01 12:00:00.0005"), (2, True, "2024-05-01 12:05:00"), (4, True, NOW), (5, False, NOW))
    assert values(schedule.new_plans(snapshot, moved), "job_id") == [(2,), (4,)]


def test_an_extra_run_does_not_hide_a_missed_firing(make):
    """Hourly from 10:00: the second firing has two runs, the third none, and a retry or a manual run stands for nothing."""
    started = lambda i, at, **k: task(i, 1, "success", at, **{"trigger": "scheduled", **k})
    t = make(
        [job(1, cron="0 * * * *"), job(2, cron="0 0 1 1 *"), job(3, kind="normal")],
        [
            started(1, "2024-05-01 10:00:03"), started(2, "2024-05-01 11:00:01"), started(3, "2024-05-01 11:30:00"),
            started(4, "2024-05-01 12:10:00", retry=1), started(5, "2024-05-01 12:11:00", trigger="manual"), started(6, "2024-05-01 09:30:00"),
            started(7, "2024-05-02 00:59:59"), started(8, "2024-05-02 02:00:00"),
        ],
    )
    got = values(schedule.missed_firings(t.jobs, t.tasks, "2024-05-01 09:15:00", "2024-05-02 02:30:00"))
    met = {10: 1, 11: 2, 24: 7, 26: 8}
    assert got == sorted([(1, datetime(2024, 5, 1 + h // 24, h % 24), met.get(h)) for h in range(10, 27)], key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_firings_are_unfolded_after_the_last_exchange(make):
    t = make([job(1, cron="*/5 * * * *")], [task(1, 1, "success", "2024-05-01 10:00:03", trigger="scheduled")])
    found = schedule.missed_firings(t.jobs, t.tasks, "2024-05-01 09:15:00", "2024-05-02 02:30:00")
    above = found._jdf.queryExecution().executedPlan().toString().split("explode(minutes")[0]
    assert "Exchange" not in above and "Join" not in above


def test_a_run_belongs_to_the_firing_of_an_earlier_day(make):
    """A day's last firing holds until the next one, over days without any; one at the start of the interval is not in it."""
    t = make(
        [job(1, cron="0 9,21 * * 1"), job(2, cron="0 0 * * *")],
        [
            task(1, 1, "success", "2024-05-09 08:00:00", trigger="scheduled"), task(2, 1, "success", "2024-05-06 08:59:59", trigger="scheduled"),
            task(3, 2, "success", "2024-05-05 10:00:00", trigger="scheduled"), task(4, 2, "success", "2024-05-07 00:00:00", trigger="scheduled"),
        ],
    )
    got = values(schedule.missed_firings(t.jobs, t.tasks, "2024-05-05 00:00:00", "2024-05-09 12:00:00"))
    assert {r for r in got if r[2]} == {(1, datetime(2024, 5, 6, 21), 1), (2, datetime(2024, 5, 7), 4)} and len(got) == 6
