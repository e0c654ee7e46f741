"""Streams fed file by file, with restarts in between."""

import json
from datetime import datetime

import pytest

from jobruns.operators import windows
from jobruns.sources.tables import Tables
from jobruns.streaming import messages, runs
from jobruns.streaming.batches import columns_of, current
from tests.conftest import values


class Feed:
    """A folder of files; each call adds one."""

    def __init__(self, folder, table, columns):
        self.folder, self.table, self.columns, self.n = str(folder), table, columns, 0

    def add(self, *rows):
        self.n += 1
        self.frame = self.table(self.columns, *rows)
        self.frame.coalesce(1).write.parquet(f"{self.folder}/f={self.n}")

    def stream(self, spark):
        schema = self.table(self.columns).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/*")


@pytest.fixture
def feed(tmp_path, table):
    return lambda columns: Feed(tmp_path / "in", table, columns)


def drain(df, folder, mode="append"):
    (df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
     .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination())


def test_json_messages_reach_their_action(spark, tmp_path, table):
    (tmp_path / "in").mkdir()
    bodies = ['{"task_id": "p"}', "r", '"s"', "gone", "[]"]
    lines = [json.dumps({"body": b, "receipt_handle": str(i), "queue": "normal", "ts": "2024-01-01T00:00:00"}) for i, b in enumerate(bodies)]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    tasks = table("task_id string, status string", ("p", "pending"), ("r", "running"), ("s", "final_failed"))
    drain(messages.message_actions(messages.read_messages(spark, str(tmp_path / "in")), tasks), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert values(got, "receipt_handle", "action") == [("0", "run"), ("1", "keep"), ("2", "delete"), ("3", "delete"), ("4", "drop")]


def test_redelivered_messages_act_once_across_restarts(spark, tmp_path, feed):
    f = feed("body string, ts time")
    f.add(("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:30"))
    drain(messages.dedup_messages(f.stream(spark)), tmp_path)
    f.add(("a", "2024-01-01 00:01:00"), ("c", "2024-01-01 00:01:00"))
    drain(messages.dedup_messages(f.stream(spark)), tmp_path)
    assert values(spark.read.parquet(f"{tmp_path}/out"), "task_id") == [("a",), ("b",), ("c",)]


def test_sliding_throughput(spark, table):
    done = table("status string, finished_at time", ("success", "2024-01-01 00:00:01"), ("failed", "2024-01-01 00:00:59"), ("final_failed", "2024-01-01 00:01:00"), ("pending", None))
    tumbling = values(runs.throughput(done), "window_start", "success", "failed")
    assert tumbling == [(datetime(2024, 1, 1, 0, 0), 1, 1), (datetime(2024, 1, 1, 0, 1), 0, 1)]
    sliding = runs.throughput(done, slide="5 seconds")
    assert sliding.count() == 24
    assert sliding.agg({"success": "sum"}).first()[0] == 12


def test_late_first_messages_are_kept(spark, tmp_path, feed):
    f = feed("body string, ts time")
    f.add(("a", "2024-01-05 00:00:00"),)
    drain(messages.dedup_messages(f.stream(spark)), tmp_path)
    f.add(("b", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:00"))
    drain(messages.dedup_messages(f.stream(spark)), tmp_path)
    assert values(spark.read.parquet(f"{tmp_path}/out"), "task_id") == [("a",), ("b",)]


def test_leases_do_not_depend_on_the_order_of_arrival(spark, tmp_path, feed, table):
    columns = "task_id long, worker_id string, ts time, kind string"
    rows = [
        (1, "w", "2024-01-01 00:00:00", "claim"), (2, "w", "2024-01-01 00:00:00", "claim"), (3, "w", "2024-01-01 00:00:00", "claim"),
        (9, "w", "2024-01-01 00:02:00", "claim"), (1, "w", "2024-01-01 00:00:20", "beat"), (4, "x", "2024-01-01 00:00:20", "beat"),
        (9, "w", "2024-01-01 00:02:10", "beat"), (3, "w", "2024-01-01 00:00:10", "finish"),
    ]
    f = feed(columns)
    for start in range(0, 8, 2):
        f.add(*rows[start : start + 2])
        runs.start_leases(f.stream(spark), str(tmp_path / "s"), f"{tmp_path}/cp", 30).awaitTermination()
    schema = "task_id long, worker_id string, locked_until timestamp_ntz"
    got = current(spark, str(tmp_path / "s"), runs.LEASE_KEYS, schema, 3)
    assert values(got) == values(runs.leases(table(columns, *rows), 30)) == [
        (1, "w", datetime(2024, 1, 1, 0, 0, 50)), (2, "w", datetime(2024, 1, 1, 0, 0, 30)), (9, "w", datetime(2024, 1, 1, 0, 2, 40)),
    ]


def test_transitions_across_batches_equal_one_batch(spark, tmp_path, feed, table):
    columns = "task_id long, ts time, seq long, status string"
    rows = [
        (1, "2024-01-01 00:00:00", 1, "pending"), (1, "2024-01-01 00:00:01", 2, "pending"), (2, "2024-01-01 00:00:01", 3, "pending"),
        (1, "2024-01-01 00:00:02", 4, "running"), (2, "2024-01-01 00:00:02", 5, "pending"),
        (1, "2024-01-01 00:00:03", 6, "running"), (3, "2024-01-01 00:00:03", 7, "failed"),
        (1, "2024-01-01 00:00:09", 8, "success"), (2, "2024-01-01 00:00:09", 9, "running"),
    ]
    f = feed(columns)
    for part in (rows[5:7], rows[0:3], rows[7:9], rows[3:5]):  # the first and the last come late
        f.add(*part)
        runs.start_transitions(f.stream(spark), str(tmp_path / "s"), f"{tmp_path}/cp").awaitTermination()
    schema = "task_id long, ts timestamp_ntz, seq long, status string, previous string, elapsed_s double"
    got = current(spark, str(tmp_path / "s"), ["task_id"], schema, 3)
    assert values(got) == values(windows.status_transitions(table(columns, *rows)))


def test_job_changes_survive_rereading(spark, tmp_path, feed, table):
    f = feed("job_id long, job_type string, enabled boolean, next_fire_at time, updated_at time")
    on = lambda i, fire, at: (i, "scheduled", True, f"2024-01-01 {fire}", f"2024-01-01 {at}")
    f.add(on(1, "01:00:00", "00:00:01"), on(2, "01:00:00", "00:00:01"), (3, "normal", True, None, "2024-01-01 00:00:01"))
    f.add((2, "scheduled", False, "2024-01-01 01:00:00", "2024-01-01 00:00:09"), on(1, "02:00:00", "00:00:08"))
    f.add(on(1, "01:00:00", "00:00:01"), on(2, "01:00:00", "00:00:01"))
    runs.start_job_changes(f.stream(spark), str(tmp_path / "s"), f"{tmp_path}/cp").awaitTermination()
    snapshot = runs.current_snapshot(spark, str(tmp_path / "s"), columns_of(f.frame.select(*runs.SNAPSHOT_COLUMNS)), 2)
    assert values(snapshot, "job_id", "next_fire_at") == [(1, datetime(2024, 1, 1, 2))]


def test_chain_goes_one_level_per_batch(spark, tmp_path, feed, table):
    edges = table("upstream_job_id long, downstream_job_id long", (1, 2), (2, 3))
    jobs = table("job_id long, enabled boolean", (1, True), (2, True), (3, True))
    columns = "task_id string, job_id long, status string, created_at time, finished_at time"
    f = feed(columns)
    done = []

    def load():
        return Tables(jobs, table(columns, *done), edges)

    for i in (1, 2):
        row = (str(i), i, "success", f"2024-01-01 00:0{i}:00", f"2024-01-01 00:0{i}:30")
        done.append(row)
        f.add(row)
        runs.start_chain(f.stream(spark), load, f"{tmp_path}/out", f"{tmp_path}/cp", lambda b: f"2024-01-01 01:0{b}:00").awaitTermination()
    assert values(spark.read.parquet(f"{tmp_path}/out"), "batch_id", "job_id", "trigger_type") == [(0, 2, "dependency"), (1, 3, "dependency")]


def test_a_job_fed_by_two_batches_is_dispatched_once(spark, tmp_path, feed, table):
    columns = "task_id string, job_id long, status string, created_at time, finished_at time, processed_for_chaining boolean"
    done = [(str(i), i, "success", f"2024-01-01 00:0{i}:00", f"2024-01-01 00:0{i}:30", i == 4) for i in (1, 2, 4)]
    tables = Tables(
        table("job_id long, enabled boolean", (1, True), (2, True), (3, True), (4, True), (5, True)),
        table(columns, *done),
        table("upstream_job_id long, downstream_job_id long", (1, 3), (2, 3), (4, 5)),
    )
    f = feed(columns)
    for row in done:
        f.add(row)
    runs.start_chain(f.stream(spark), lambda: tables, f"{tmp_path}/out", f"{tmp_path}/cp", lambda b: f"2024-01-01 01:0{b}:00", f"{tmp_path}/marks").awaitTermination()
    assert values(spark.read.parquet(f"{tmp_path}/out"), "batch_id", "job_id") == [(0, 3)]
    assert values(spark.read.parquet(f"{tmp_path}/marks"), "task_id") == [("1",), ("2",)]


def test_an_orphan_comes_out_once_over_restarts(spark, tmp_path, feed):
    f = feed("task_id long, worker_id string, ts time, kind string")
    minute = lambda m, s=0: f"2024-01-01 00:{m:02d}:{s:02d}"
    files = [
        [(1, "w", minute(0, 10), "beat"), (2, "w", minute(0), "claim")], [(1, "w", minute(0), "claim"), (3, "w", minute(0, 5), "claim")],
        [(3, "w", minute(0, 20), "finish"), (None, None, minute(10), None)], [(4, "w", minute(11), "claim")], [(None, None, minute(30), None)], [(None, None, minute(40), None)],
    ]
    for rows in files:
        f.add(*rows)
        drain(runs.lease_orphans(f.stream(spark), 30, "2 minutes"), tmp_path)
    assert values(spark.read.parquet(f"{tmp_path}/out"), "task_id", "locked_until") == [
        (1, datetime(2024, 1, 1, 0, 0, 40)), (2, datetime(2024, 1, 1, 0, 0, 30)), (4, datetime(2024, 1, 1, 0, 11, 30)),
    ]


def test_sliding_windows_from_panes_equal_sliding_windows(table):
    times = ["00:00:01", "00:00:03", "00:00:59", "00:01:00", "00:07:31"]
    done = table("status string, finished_at time", *[("failed" if i % 2 else "success", f"2024-01-01 {t}") for i, t in enumerate(times)], ("success", None))
    assert values(runs.throughput_sliding(done)) == values(runs.throughput(done, slide="5 seconds"))


def test_a_batch_of_versions_writes_what_it_touches(spark, tmp_path, feed):
    """The last of many batches writes and reads no more than the second."""
    f = feed("job_id long, job_type string, enabled boolean, next_fire_at time, updated_at time")
    for n in range(12):
        f.add(*[(i, "scheduled", True, "2024-01-01 01:00:00", f"2024-01-01 00:00:{n:02d}") for i in range(n, n + 5)])
    query = runs.start_job_changes(f.stream(spark), str(tmp_path / "s"), f"{tmp_path}/cp")
    query.awaitTermination()
    rows = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert rows == [5] * 12
    written = [spark.read.parquet(f"{tmp_path}/s/out/batch_id={n}").count() for n in range(12)]
    assert written == [5] * 12


def test_ids_that_only_read_as_a_key_are_none(table):
    sent = table("body string", ("7",), ("007",), ("x",))
    tasks = table("task_id long, status string", (7, "pending"))
    assert values(messages.message_actions(sent, tasks), "body", "action") == [("007", "delete"), ("7", "run"), ("x", "delete")]


def test_a_large_batch_is_several_files(spark, monkeypatch):
    """No task writes or reads a whole batch of a large table, and the batches stay as many as they were."""
    from jobruns import fixtures as fx

    monkeypatch.setattr(fx, "ROWS_PER_FILE", 100)
    rows = fx.raw(spark, "/root/testdata/sf0.001", "orders").count()
    feed = fx.stream(spark, "/root/testdata/sf0.001", "orders")
    query = feed.writeStream.format("noop").option("checkpointLocation", f"{fx.shared_dir(spark)}/cp-{fx.uuid.uuid4()}").trigger(availableNow=True).start()
    query.awaitTermination()
    taken = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(taken) == 4 and sum(taken) == rows > 400
    written = spark.read.parquet(_folder(feed))
    sizes = [r["count"] for r in written.groupBy(written["_metadata.file_path"].alias("f")).count().collect()]
    assert sum(sizes) == rows and max(sizes) <= 200


def _folder(feed):
    """The newest folder that was written for a stream."""
    import glob
    import os

    from jobruns.session import shared_dir

    return max(glob.glob(f"{shared_dir(feed.sparkSession)}/feed-*"), key=os.path.getmtime)
