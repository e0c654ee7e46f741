from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobruns.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """``table("a long, at time", (1, "2024-01-01 00:00:00"))``: literal rows; ``time`` columns are given as text."""

    def make(columns: str, *rows: tuple):
        fields = [c.strip().rsplit(" ", 1) for c in columns.split(", ")]
        schema = ", ".join(f"`{n}` {'string' if t == 'time' else t}" for n, t in fields)
        df = spark.createDataFrame(list(rows), schema)
        return df.select(*[df[n].cast("timestamp_ntz").alias(n) if t == "time" else df[n] for n, t in fields])

    return make


def values(df, *columns):
    """Sorted rows as tuples."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))
