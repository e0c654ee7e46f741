"""Small arithmetic of sizing and display bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(col: Column, lo: int, hi: int) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col))


def pages(total: Column, page_size: int) -> Column:
    """Number of pages, at least one."""
    return F.greatest(F.ceil(total / page_size), F.lit(1)).cast("long")


def workers_needed(depth: Column, per_worker: int) -> Column:
    """Workers that absorb a backlog; none when idle."""
    return F.ceil(depth / per_worker).cast("long")


def band(col: Column, *steps: tuple[int, str], base: str = "green") -> Column:
    """Name of the highest step that ``col`` has reached."""
    out = F.lit(base)
    for threshold, name in sorted(steps):
        out = F.when(col >= threshold, F.lit(name)).otherwise(out)
    return out


def resource_units(cpu: Column, memory_mb: Column) -> Column:
    """Container limits as text: millicores and mebibytes; null means no limit."""
    return F.struct(
        F.concat((cpu * 1000).cast("int").cast("string"), F.lit("m")).alias("cpu"),
        F.concat(memory_mb.cast("string"), F.lit("Mi")).alias("memory"),
    )
