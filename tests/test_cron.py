"""Cron expressions against a minute-by-minute search."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobruns.functions import cron
from jobruns.functions.times import as_time
from jobruns.operators import schedule

EXPRESSIONS = [
    "* * * * *", "*/5 * * * *", "0 2 * * *", "30 6 1 * 1", "15,45 9-17/4 * 2 *", "0 0 * jan-mar mon",
    "0 0 * * fri-sun", "5/20 * * * *", "0 12 * * 7", "59 23 31 * *", "0 0 13 * 5", "*/7 */5 * * *",
    "0 0 1,15 */2 *", "10-20/3,40 0 * * 1-5", "0 4 */10 * *", "0 0 */2 * 3",
]
INVALID = [
    "61 * * * *", "0 24 * * *", "* * 0 * *", "* * * 13 *", "* * * * 8", "0 2 * *", "* * * * * *", "@never", "0 0 L-2 * *", "0 0 * * 5#6", "0 0 * * L8", "0 0 * * #2",
    "1- * * * *", "*/0 * * * *", "1,,2 * * * *", "", "L * * * *", "5-1 * * * *", "a b c d e", "*-3 * * * *",
]
NAMES = {n: i for i, n in enumerate("sun mon tue wed thu fri sat".split())} | {
    n: i + 1 for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())
}


def allowed(field: str, lo: int, hi: int) -> set[int]:
    out = set()
    for item in field.split(","):
        span, _, step = item.partition("/")
        a, dash, b = span.partition("-")
        number = lambda t: NAMES[t] if t in NAMES else int(t)
        first = lo if a == "*" else number(a)
        last = hi if a == "*" or (step and not dash) else number(b) if dash else first
        if dash and hi == 7 and last == 0:
            last = 7
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def fires(expression: str, t: datetime) -> bool:
    minute, hour, day, month, weekday = expression.split()
    d = t.day in allowed(day, 1, 31)
    w = (t.isoweekday() % 7) in {v % 7 for v in allowed(weekday, 0, 7)}
    either = day != "*" and weekday != "*"
    return (
        t.minute in allowed(minute, 0, 59)
        and t.hour in allowed(hour, 0, 23)
        and t.month in allowed(month, 1, 12)
        and ((d or w) if either else (d and w))
    )


def search(expression: str, base: datetime) -> datetime:
    t = base.replace(second=0, microsecond=0) + timedelta(minutes=1)
    while not fires(expression, t):
        # Skip whole days that cannot match.
        midnight = t.replace(hour=0, minute=0)
        if not any(fires(expression, midnight + timedelta(minutes=m)) for m in range(1440)):
            t = midnight + timedelta(days=1)
        else:
            t += timedelta(minutes=1)
    return t


@pytest.mark.parametrize("base", ["2024-02-28 23:59:30", "2023-12-31 23:59:00", "2024-06-15 12:00:00"])
def test_next_fire(spark, base):
    jobs = spark.createDataFrame([(i, e) for i, e in enumerate(EXPRESSIONS)], "job_id long, cron_expression string")
    got = {r.cron_expression: r.fires_at for r in schedule.next_fire(jobs, base).collect()}
    assert got == {e: search(e, datetime.fromisoformat(base)) for e in EXPRESSIONS}


def test_validity(spark):
    df = spark.createDataFrame([(e,) for e in [*EXPRESSIONS, *INVALID, None]], "e string")
    got = {r.e: r.ok for r in df.select("e", cron.valid_cron("e").alias("ok")).collect()}
    assert got == {e: True for e in EXPRESSIONS} | {e: False for e in INVALID} | {None: False}


SPECIAL = {
    "@hourly": "2024-02-28 12:00:00", "@daily": "2024-02-29 00:00:00", "@Midnight": "2024-02-29 00:00:00",
    "@weekly": "2024-03-03 00:00:00", "@monthly": "2024-03-01 00:00:00", "@yearly": "2025-01-01 00:00:00",
    "@annually": "2025-01-01 00:00:00", "0 2 L * *": "2024-02-29 02:00:00", "30 1 1,l * *": "2024-02-29 01:30:00",
    "0 0 * * 5#2": "2024-03-08 00:00:00", "0 0 * * thu#5": "2024-02-29 00:00:00", "0 0 * * L5": "2024-03-29 00:00:00",
    "0 0 * * L7": "2024-03-31 00:00:00", "0 0 * * mon,5#1": "2024-03-01 00:00:00", "0 0 L * 1#1": "2024-02-29 00:00:00",
}


def test_aliases_last_days_and_numbered_weekdays(spark):
    jobs = spark.createDataFrame([(e,) for e in SPECIAL], "cron_expression string")
    got = {r.cron_expression: str(r.fires_at) for r in schedule.next_fire(jobs, "2024-02-28 11:00:00").collect()}
    assert got == SPECIAL


def test_leap_day_and_impossible_date(spark):
    jobs = spark.createDataFrame([(1, "0 0 29 2 *"), (2, "0 0 31 2 *")], "job_id long, cron_expression string")
    got = {r.job_id: r.fires_at for r in schedule.next_fire(jobs, "2097-01-01 00:00:00").collect()}
    assert got == {1: datetime(2104, 2, 29), 2: None}


def test_calendar_holds_exactly_the_matching_minutes(spark):
    jobs = spark.createDataFrame([(i, e) for i, e in enumerate(EXPRESSIONS)], "job_id long, cron_expression string")
    start, end = datetime(2024, 2, 28, 22, 30), datetime(2024, 3, 1, 9, 45)
    got = {(r.job_id, r.fire_at) for r in schedule.fire_calendar(jobs, start, end).collect()}
    minutes = [start + timedelta(minutes=m) for m in range(1, int((end - start).total_seconds() // 60) + 1)]
    assert got == {(i, t) for i, e in enumerate(EXPRESSIONS) for t in minutes if fires(e, t)}


def test_calendar_starts_with_the_next_firing(spark):
    jobs = spark.createDataFrame([(i, e) for i, e in enumerate(EXPRESSIONS[:6])], "job_id long, cron_expression string")
    base = as_time("2024-01-31 10:00:00")
    first = schedule.fire_calendar(jobs, base, "2024-02-20 00:00:00").groupBy("job_id").agg(F.min("fire_at").alias("t"))
    nxt = schedule.next_fire(jobs, base)
    assert first.join(nxt, "job_id").where("t <> fires_at").count() == 0


def test_classify_trims_and_rejects(spark):
    jobs = spark.createDataFrame(
        [(1, "  */5 * * * * "), (2, "   "), (3, None), (4, "bad")], "job_id long, cron_expression string"
    )
    got = {r.job_id: (r.job_type, r.cron_expression, r.next_fire_at, r.error)
           for r in schedule.classify_schedule(jobs, "2024-01-01 00:00:00").collect()}
    assert got == {
        1: ("scheduled", "*/5 * * * *", datetime(2024, 1, 1, 0, 5), None),
        2: ("normal", None, None, None),
        3: ("normal", None, None, None),
        4: (None, "bad", None, "Invalid cron expression"),
    }
