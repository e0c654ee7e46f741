"""Times are ``timestamp_ntz`` columns holding UTC wall-clock time."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

TimeLike = Column | datetime | str

_EPOCH = "1970-01-01 00:00:00"


def as_time(value: TimeLike) -> Column:
    """A time given as column, datetime (aware values are moved to UTC) or ISO text."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(UTC).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def utc_wall_clock(col: Column) -> Column:
    """``timestamp`` (an instant) to ``timestamp_ntz`` in UTC, whatever the session zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))


def as_instant(col: Column) -> Column:
    """UTC wall-clock time to ``timestamp``, which watermarks need; :func:`utc_wall_clock` is the way back."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), col).cast("timestamp")


def seconds(n: Column | int | float) -> Column:
    """An interval of ``n`` seconds; add it to or subtract it from a time."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.expr("INTERVAL '1' SECOND") * n


def micros(col: Column) -> Column:
    """Microseconds since 1970 of a UTC wall-clock time."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), col)


def truncated(unit: str, col: Column | str) -> Column:
    """Start of the minute, hour or day of a time, in whatever zone the session is."""
    col = F.col(col) if isinstance(col, str) else col
    day = F.to_date(col).cast("timestamp_ntz")
    if unit == "day":
        return day
    if unit == "hour":
        return day + F.expr("INTERVAL '1' HOUR") * F.hour(col)
    if unit == "minute":
        return day + F.expr("INTERVAL '1' MINUTE") * (F.hour(col) * 60 + F.minute(col))
    raise ValueError(f"unit must be minute, hour or day, not {unit}")


def completed_at(finished: str = "finished_at", created: str = "created_at") -> Column:
    """When a run counts as completed: its finish, or its creation while it has none."""
    return F.coalesce(F.col(finished), F.col(created))


def same_firing(left: Column, right: Column, slack_micros: int = 1_000) -> Column:
    """Two firing times that differ by no more than one millisecond are the same firing."""
    return F.abs(micros(left) - micros(right)) <= slack_micros
