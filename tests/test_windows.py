"""Latest rows, sliced windows, counters and running totals."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobruns.operators import aggregates, queues, windows
from tests.conftest import values

T0 = datetime(2024, 1, 1)


def at(seconds: float) -> str:
    return (T0 + timedelta(seconds=seconds)).isoformat(sep=" ")


def samples(seed: int, n: int = 300):
    """Series of very different size, with resets, gaps and equal times."""
    rng = random.Random(seed)
    rows = []
    for series, share in (("hot", 0.7), ("warm", 0.28), ("one", 0.0)):
        t, v = 0, 5.0
        for _ in range(max(1, int(n * share))):
            t += rng.choice([0, 1, 1, 2, 5, 40, 400])
            v = rng.choice([v + 1, v + 3, v, 1.0]) if rng.random() < 0.9 else 0.0
            rows.append((series, t, v))
    return rows


def brute_increase(rows, window):
    out = {}
    for series in {r[0] for r in rows}:
        own = sorted((t, v) for s, t, v in rows if s == series)
        steps = [(t, 0.0 if i == 0 else (v if v < own[i - 1][1] else v - own[i - 1][1])) for i, (t, v) in enumerate(own)]
        for t, v in own:
            key = (series, T0 + timedelta(seconds=t), v)
            out.setdefault(key, sum(s for u, s in steps if t - window < u <= t))
    return out


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 50, 7, 1])
@pytest.mark.parametrize("window", [1, 30, 500])
def test_increase_does_not_depend_on_slices(spark, table, rows_per_slice, window):
    rows = samples(window)
    df = table("series string, ts time, value double", *[(s, at(t), v) for s, t, v in rows])
    got = windows.counter_increase(df, window, rows_per_slice=rows_per_slice).collect()
    assert len(got) == len(rows)
    expected = brute_increase(rows, window)
    for r in got:
        assert r.increase == pytest.approx(expected[(r.series, r.ts, r.value)]), r


def test_a_hot_series_is_cut_into_many_slices(spark, table):
    from jobruns.operators.slices import assign_slices

    rows = samples(3, 1000)
    df = table("series string, ts time, value double", *[(s, at(t), v) for s, t, v in rows])
    sliced = assign_slices(df, ["series"], "ts", 50)
    counts = {r.series: r.n for r in sliced.groupBy("series").agg(F.countDistinct("_slice").alias("n")).collect()}
    assert counts["hot"] > 5 and counts["one"] == 1


def test_rate_scales(table):
    df = table("series string, ts time, value double", ("c", at(0), 0.0), ("c", at(10), 3.0))
    assert values(windows.counter_rate(df, 30, 100), "rate") == [(0.0,), (10.0,)]


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 5, 1])
def test_transitions(table, rows_per_slice):
    states = ["pending", "pending", "running", "running", "success"]
    rows = [(1, at(i), i, s) for i, s in enumerate(states)] + [(2, at(0), 9, "pending")]
    df = table("task_id long, ts time, seq long, status string", *rows)
    got = windows.status_transitions(df, rows_per_slice)
    assert values(got, "task_id", "status", "previous", "elapsed_s") == [
        (1, "pending", None, 0.0), (1, "running", "pending", 2.0), (1, "success", "running", 4.0), (2, "pending", None, 0.0)
    ]


def test_latest_run_ties_go_to_the_larger_key(table):
    df = table("task_id long, job_id long, status string, created_at time", (1, 1, "a", at(0)), (2, 1, "b", at(0)), (3, 2, "c", at(5)), (4, 2, "d", at(1)))
    assert values(windows.latest_run_per_job(df), "job_id", "status") == [(1, "b"), (2, "c")]
    only = table("job_id long", (2,))
    assert values(windows.latest_run_per_job(df, only), "job_id", "status") == [(2, "c")]


def test_staircase_ends_at_the_counters(spark):
    from jobruns import fixtures as fx

    tasks = fx.tasks(spark, "/root/testdata/sf0.001")
    last = windows.cumulative_counts(tasks).orderBy(F.desc("bucket")).first()
    total = aggregates.outcome_counters(tasks).first()
    assert (last.created, last.succeeded, last.failed) == (total.created_total, total.succeeded_total, total.failed_total)


def test_depth_timeline_with_returns(table):
    df = table(
        "queue string, ts time, op string",
        ("q", at(0), "send"), ("q", at(0), "send"), ("q", at(61), "receive"), ("q", at(122), "return"),
        ("q", at(90_000), "receive"), ("q", at(90_060), "delete"), ("r", at(0), "send"),
    )
    got = queues.queue_depth_timeline(df).orderBy("queue", "bucket").collect()
    assert [(r.queue, r.visible, r.not_visible) for r in got] == [
        ("q", 2, 0), ("q", 1, 1), ("q", 2, 0), ("q", 1, 1), ("q", 1, 0), ("r", 1, 0)
    ]


def test_sizing(table):
    df = table("queue string, ts time, visible long, not_visible long", *[
        row for i, depth in enumerate([(0, 0, 0), (50, 0, 0), (10, 10, 5), (1, 0, 0), (10000, 0, 0)])
        for row in [(q, at(i), d, None) for q, d in zip(("normal", "scheduled", "retry"), depth)]
    ])
    got = aggregates.fleet_size(df).orderBy("ts").collect()
    assert [r.desired for r in got] == [1, 3, 2, 1, 10]
    assert [r.needed for r in got] == [0, 3, 2, 1, 500]
    busy = table("queue string, ts time, visible long, not_visible long", ("q", at(0), 0, 45))
    assert aggregates.fleet_size(busy).first().desired == 3
    assert aggregates.queue_replicas(busy).first().replicas == 1


def test_empty_tables_still_report_zeros(table):
    tasks = table("task_id long, job_id long, status string, trigger_type string, retry_count int, finished_at time")
    jobs = table("job_id long, job_type string, enabled boolean, next_fire_at time")
    assert {r["count"] for r in aggregates.active_by_queue(tasks, jobs).collect()} == {0.0}
    assert aggregates.active_by_queue(tasks, jobs).count() == 6
    long = {(r.metric, r.labels): r.value for r in aggregates.metrics_long(tasks, jobs, at(0)).collect()}
    assert long[("tasks_created_total", "")] == 0.0 and len(long) == 15
    assert tuple(aggregates.status_tiles(tasks).first()) == (0, 0, 0, 0, 0)
    assert aggregates.outcome_counters(tasks).first().failed_total == 0.0


def test_an_outlier_and_a_burst_leave_no_slice_with_more_than_twice_its_share(spark):
    from jobruns.operators.slices import assign_slices

    even = spark.range(20_000).select(F.lit("s").alias("series"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp_ntz").alias("ts"))
    burst = spark.range(20_000).select(F.lit("s").alias("series"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id")).cast("timestamp_ntz").alias("ts"))
    df = even.unionByName(burst).unionByName(spark.sql("SELECT 's' AS series, TIMESTAMP_NTZ'1970-01-01 00:00:00' AS ts"))
    sizes = [r["count"] for r in assign_slices(df, ["series"], "ts", 1000).groupBy("_slice").count().collect()]
    assert sum(sizes) == 40_001 and len(sizes) > 35 and max(sizes) <= 2000


def test_a_burst_inside_one_window(spark, table):
    rows = [("c", f"2024-01-01 00:00:{s:02d}.{m:03d}", float(s * 100 + m)) for s in range(3) for m in range(0, 100, 5)] + [("c", "1970-01-01 00:00:00", 1.0)]
    df = table("series string, ts time, value double", *rows)
    every = values(windows.counter_increase(df, 30, rows_per_slice=1_000))
    assert values(windows.counter_increase(df, 30, rows_per_slice=4)) == every
