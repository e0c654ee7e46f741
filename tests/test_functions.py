"""Scalar functions and selections."""

import json

import pytest
from pyspark.sql import functions as F

from jobruns.functions import sizing, specs, text
from jobruns.operators import definitions, joins, select
from tests.conftest import values

# A body, and the run it is for.
BODIES = [
    ('abc', 'abc'),
    ('"abc"', 'abc'),
    ('{"task_id":"a"}', 'a'),
    ('{"task_id":5}', '5'),
    ('{"task_id":0}', None),
    ('{"task_id":"0"}', '0'),
    ('{"task_id":true}', 'True'),
    ('{"task_id":false}', None),
    ('{"task_id":"true"}', 'true'),
    ('{"task_id":null}', None),
    ('{"task_id":""}', None),
    ('{}', None),
    ('[1]', None),
    ('5', None),
    ('-0', None),
    ('007', '007'),
    ('true', None),
    ('null', None),
    ('NaN', None),
    ('', None),
    ('""', None),
    (' ', ' '),
    ('{"task_id":"a"', '{"task_id":"a"'),
    ('{"task_id":"a"} x', '{"task_id":"a"} x'),
    ('{"task_id":"a","task_id":"b"}', 'b'),
    ('"x" y', '"x" y'),
    ('{"a":{"task_id":"q"}}', None),
    ('f47ac10b-58cc-4372-a567-0e02b2c3d479', 'f47ac10b-58cc-4372-a567-0e02b2c3d479'),
    ('1e5', None),
    ('  {"task_id":"z"}', 'z'),
    ('[1', '[1'),
    ('{"task_id":1.5}', '1.5'),
    ('{"task_id":"\\u00e9"}', 'é'),
    ("{'task_id':'a'}", "{'task_id':'a'}"),
    ('{"task_id":"a",}', '{"task_id":"a",}'),
    ('tru', 'tru'),
]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_message_bodies(spark):
    df = spark.createDataFrame([(b,) for b, _ in BODIES], "body string")
    got = {r.body: r.t for r in df.select("body", text.task_id_of(F.col("body")).alias("t")).collect()}
    assert got == dict(BODIES)


def test_truncation(spark):
    cut = lambda s, cap: one(spark, text.truncate_output(F.lit(s), cap))
    assert cut("abcd", 4) == "abcd"
    assert cut("abcde", 4) == "abcd\n...[truncated]"
    assert one(spark, text.truncate_output(F.lit(None).cast("string"))) is None


def test_text_helpers(spark):
    assert one(spark, text.blank_to_null(F.lit(" \t\n"))) is None
    assert one(spark, text.blank_to_null(F.lit(" a b "))) == "a b"
    assert one(spark, text.key_value_map(F.array(*map(F.lit, ["A=1", "B", "=x", "C=a=b", "A=2"])))) == {"A": "2", "B": "", "C": "a=b"}
    assert one(spark, text.normalise_uuid(F.lit("{F47AC10B58CC4372A5670E02B2C3D479}"))) == "f47ac10b-58cc-4372-a567-0e02b2c3d479"
    assert one(spark, text.normalise_uuid(F.lit("f47ac10b"))) is None
    raw = b"ok\xff\xfe\xc3("
    assert one(spark, text.decode_text(F.lit(raw))) == raw.decode(errors="replace")
    assert one(spark, text.env_ok(F.create_map(F.lit("A_1"), F.lit("x")))) is True
    assert one(spark, text.env_ok(F.create_map(F.lit("1A"), F.lit("x")))) is False


def test_bands_and_units(spark):
    b = lambda v: one(spark, sizing.band(F.lit(v), (1000, "orange"), (10000, "red")))
    assert [b(999), b(1000), b(10000)] == ["green", "orange", "red"]
    assert tuple(one(spark, sizing.resource_units(F.lit(0.5), F.lit(256)))) == ("500m", "256Mi")
    assert tuple(one(spark, sizing.resource_units(F.lit(None).cast("double"), F.lit(None).cast("int")))) == (None, None)


@pytest.mark.parametrize("body", [{"k": "v"}, {"a": [1, {"b": "x, y: z"}], "c": 'q"u,o:te'}, "plain, text: here", '{"as": "text"}', None])
def test_http_command(spark, body):
    config = {"method": "post", "url": "https://api.example", "headers": {"X-B": "1", "X-A": "2"}}
    if body is not None:
        config["body"] = body
    command = ["curl", "-fsS", "-X", "POST", "-H", "X-B: 1", "-H", "X-A: 2"]
    if body is not None:
        command += ["-d", body if isinstance(body, str) else json.dumps(body)]
    spec = one(spark, specs.runtime_spec(F.lit("http"), F.lit(json.dumps(config, separators=(",", ":")))))
    assert spec.image == "curlimages/curl:8.6.0"
    assert spec.command == [*command, "https://api.example"]
    assert spec.timeout_seconds == 30 and spec.env == {}


def test_shell_command_and_errors(spark):
    shell = F.lit('{"command": "echo hi", "timeout_seconds": 7}')
    spec = one(spark, specs.runtime_spec(F.lit("shell"), shell))
    assert (spec.image, spec.command, spec.timeout_seconds) == ("alpine:3", ["sh", "-c", "echo hi"], 7)
    assert one(spark, specs.runtime_spec(F.lit("shell"), shell, shell_enabled=False)) is None
    assert one(spark, specs.runtime_spec_error(F.lit("shell"), shell, shell_enabled=False)) == "Shell actions are disabled"
    assert one(spark, specs.runtime_spec(F.lit("ftp"), F.lit("{}"))) is None
    assert one(spark, specs.runtime_spec_error(F.lit("ftp"), F.lit("{}"))) == "Unsupported action_type: ftp"


def test_config_defaults(spark):
    c = one(spark, specs.http_config(F.lit('{"url": "u"}')))
    assert (c.method, c.headers, c.body, c.timeout_seconds) == ("GET", {}, None, 30)


def test_invalid_jobs(table):
    good = dict(name="n", cron_expression="* * * * *", action_type="http", action_config='{"url":"u"}', concurrency_policy="allow", max_retries=0)
    cases = {
        1: {}, 2: {"name": "\t"}, 3: {"max_retries": -1}, 4: {"action_config": '{"url":"u","timeout_seconds":0}'},
        5: {"action_config": "{}"}, 6: {"action_type": "shell", "action_config": "{}"},
        7: {"action_config": '{"url":"u","headers":{"a":1}}'}, 8: {"action_config": '{"url":"u","body":[1]}'},
        9: {"action_config": '{"url":"u","body":{"a":1}}'}, 10: {"action_type": "ftp"}, 11: {"concurrency_policy": "Allow"},
        12: {"cron_expression": "nope"}, 13: {"action_config": "not json"}, 14: {"name": "twin"}, 15: {"name": "twin"},
        16: {"action_config": '{"url":"u","timeout_seconds":"x"}'}, 17: {"action_config": '{"url":"u","body":null,"headers":{}}'},
    }
    rows = [tuple({"name": f"n{i}"}.get(k, v) if k == "name" and "name" not in c else {**good, **c}[k] for k, v in good.items()) for i, c in cases.items()]
    jobs = table(
        "job_id long, name string, cron_expression string, action_type string, action_config string, concurrency_policy string, max_retries int",
        *[(i, *row) for i, row in zip(cases, rows)],
    )
    assert sorted(map(tuple, definitions.invalid_jobs(jobs).collect())) == [
        (2, "empty name"), (3, "negative max_retries"), (4, "timeout_seconds below 1"), (5, "missing url"),
        (6, "missing command"), (7, "headers are not an object of strings"), (8, "body is neither text nor object"),
        (10, "unknown action_type"), (11, "unknown concurrency_policy"), (12, "Invalid cron expression"),
        (13, "action_config is no JSON object"), (13, "missing url"), (14, "duplicate name"), (15, "duplicate name"),
        (16, "timeout_seconds below 1"),
    ]


def test_filters_and_paging(table):
    jobs = table(
        "job_id long, name string, enabled boolean, action_type string, concurrency_policy string, created_at time",
        (1, "Alpha_1", True, "http", "allow", "2024-01-01 00:00:00"), (2, "beta", False, "shell", "forbid", "2024-01-02 00:00:00"),
        (3, "alphaX1", True, "shell", "replace", "2024-01-03 00:00:00"),
    )
    ids = lambda **kw: [r[0] for r in values(select.filter_jobs(jobs, **kw), "job_id")]
    assert ids() == [1, 2, 3] and ids(q="") == [1, 2, 3]
    assert ids(enabled=False) == [2] and ids(action_type="shell", enabled=True) == [3]
    assert ids(q="PHA_1") == [1, 3] and ids(q="%") == [1, 2, 3]
    assert [r.job_id for r in select.page(jobs, 1, 2).collect()] == [3, 2]
    assert [r.job_id for r in select.page(jobs, 2, 2).collect()] == [1]
    assert tuple(select.page_envelope(jobs, 2, 2).first()) == (2, 2, 3, 2, 3, 3)
    assert tuple(select.page_envelope(jobs.limit(0), 1, 20).first()) == (1, 20, 0, 1, 0, 0)
    with pytest.raises(ValueError):
        select.page(jobs, 1, 101)


def test_pages_keep_rows_of_equal_and_missing_times(spark):
    rows = spark.range(97).selectExpr("id AS job_id", "IF(id % 3 = 0, NULL, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS created_at")
    expected = sorted(range(97), key=lambda i: (i % 3 == 0, -i))
    got = [r.job_id for p in range(1, 11) for r in select.page(rows, p, 10).collect()]
    assert got == expected


def test_adjacency_has_one_shape(spark):
    edges = spark.createDataFrame([(1, i) for i in range(2, 502)] + [(2, 3)], "upstream_job_id long, downstream_job_id long")
    jobs = spark.createDataFrame([(i,) for i in (1, 2, 3, 999)], "job_id long")
    rows = values(joins.adjacency(jobs, edges))
    assert rows == sorted(
        [(1, "downstream", i) for i in range(2, 502)] + [(2, "downstream", 3), (2, "upstream", 1), (3, "upstream", 1), (3, "upstream", 2)],
        key=lambda r: tuple((True, str(v)) for v in r),
    )
    lists = {r.job_id: (r.upstream_job_ids, r.downstream_job_ids) for r in joins.adjacency_lists(jobs, edges).collect()}
    assert lists == {1: ([], list(range(2, 502))), 2: ([1], [3]), 3: ([1, 2], []), 999: ([], [])}


def test_victims(table):
    workers = table("name string, autoscaled boolean, created string", ("base", False, "2020"), ("b", True, "2024-02"), ("a", True, "2024-03"), ("c", True, None))
    assert [r.name for r in select.scale_down_victims(workers, 2).collect()] == ["c", "b"]
    assert select.scale_down_victims(workers, -1).count() == 0


def test_far_pages_are_looked_up(spark, monkeypatch):
    """Every page of rows with bursts, ties, an outlier and rows without a time, as one sorted list has them."""
    monkeypatch.setattr(select, "NEAR", 5)
    monkeypatch.setattr(select, "PARTS", 4)
    second = lambda i: 1_700_000_000 + (0 if i % 3 == 0 else i)
    times = {i: None if i % 10 == 9 else 5 if i == 4 else second(i) for i in range(60)}
    rows = spark.createDataFrame(list(times.items()), "job_id long, s long").selectExpr("job_id", "CAST(timestamp_seconds(s) AS timestamp_ntz) AS created_at")
    expected = sorted(times, key=lambda i: (times[i] is None, -(times[i] or 0), -i))
    got = [r.job_id for p in (1, 2, 4, 5, 7, 9, 10) for r in select.page(rows, p, 7).collect()]
    assert got == [i for p in (1, 2, 4, 5, 7, 9, 10) for i in expected[(p - 1) * 7 : p * 7]]
