"""Slices of rows: ordered windows over a group that may be too large for one task.

A window over ``(series, order by ts)`` puts a whole series into one task. The functions here cut
every group at times between which about equally many of its rows lie, run the window inside ``(group, slice)``, and carry what a
slice needs from earlier ones in a frame with one row per slice. An outlying time or a burst moves the borders and fills no
slice; only rows of one and the same time stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobruns.functions.times import micros, truncated

ROWS_PER_SLICE = 100_000
#: Slices of one group at most; beyond, slices hold more rows.
MOST_SLICES = 1000


def borders(df: DataFrame, keys: Sequence[str], ts: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``(*keys, _first, _borders)``: a group's first time, and the last times of its slices but the last one, in microseconds."""
    at = micros(F.col(ts))
    spans = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    most = spans.agg(F.max("_n")).first()[0] or 0
    steps = min(MOST_SLICES, -(-most // rows_per_slice))
    if steps <= 1:
        return spans.select(*keys, "_first", F.array().cast("array<bigint>").alias("_borders"))
    large = spans.where(F.col("_n") > rows_per_slice).select(*keys)
    shares = [k / steps for k in range(1, steps)]
    cuts = df.join(large, list(keys), "left_semi").groupBy(*keys).agg(F.percentile_approx(at, shares, 10 * MOST_SLICES).alias("_cuts"))
    # A smaller group has fewer slices: every second or third border, and so on.
    stride = F.greatest(F.lit(1), F.floor(F.lit(steps) / F.ceil(F.col("_n") / rows_per_slice)))
    own = F.array_distinct(F.filter("_cuts", lambda cut, i: (i + 1) % stride == 0))
    return spans.join(cuts, list(keys), "left").select(*keys, "_first", F.coalesce(own, F.array().cast("array<bigint>")).alias("_borders"))


def slice_of(at: Column) -> Column:
    """The number of the slice in which a time lies; 0 without a time."""
    return F.coalesce(F.size(F.filter("_borders", lambda b: b < at)), F.lit(0))


def assign_slices(df: DataFrame, keys: Sequence[str], ts: str, rows_per_slice: int = ROWS_PER_SLICE, cuts: DataFrame | None = None) -> DataFrame:
    """Add ``_slice`` and ``_first`` (the group's first time in microseconds). Rows are dealt by group and slice, so a large group is
    spread. ``cuts`` are the :func:`borders`, if they are known."""
    cuts = borders(df, keys, ts, rows_per_slice) if cuts is None else cuts
    return df.join(cuts, list(keys), "left").withColumn("_slice", slice_of(micros(F.col(ts)))).drop("_borders").repartition(*keys, "_slice")


def with_previous(sliced: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``value`` of the preceding row of the same group, across slice borders."""
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    boxed = F.struct(F.col(value).alias("v"))
    # The last row of each slice: as few rows as there are slices.
    ends = sliced.groupBy(*keys, "_slice").agg(F.max(F.struct(*order, F.col(value).alias("_v"))).alias("_end"))
    last = F.struct(F.col("_end._v").alias("v"))
    carry = ends.select(
        *keys, "_slice", F.lag(last).over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carry")
    ).where(F.col("_carry").isNotNull())
    return (
        sliced.withColumn("_prev", F.lag(boxed).over(inside))
        .join(carry, [*keys, "_slice"], "left")
        .withColumn(name, F.coalesce("_prev", "_carry")["v"])
        .drop("_prev", "_carry")
    )


def running_totals(
    buckets: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], span: str = "day"
) -> DataFrame:
    """Running sums of ``values`` in time order, one row per group and bucket in, one out.

    Summed inside each span first, then over the span totals: the only window that crosses spans
    has one row per group and day.
    """
    day = truncated(span, F.col(ts))
    sums = [F.sum(v).alias(f"_t_{v}") for v in values]
    totals = buckets.groupBy(*keys, day.alias("_span")).agg(*sums)
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_span", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values]
    )
    inside = Window.partitionBy(*keys, "_span").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return (
        # Every bucket has its span in carry. As a left join it adds no condition to the buckets, which
        # therefore come from the same exchange as the totals.
        buckets.withColumn("_span", day)
        .join(carry, [*keys, "_span"], "left")
        .select(*keys, ts, *[(F.sum(v).over(inside) + F.col(f"_b_{v}")).alias(v) for v in values])
    )


def trailing_sum(
    sliced: DataFrame, keys: Sequence[str], ts: str, value: str, window_seconds: int, name: str, cuts: DataFrame
) -> DataFrame:
    """Sum of ``value`` over ``(ts - window, ts]``: what was summed up to a time, less what was up to a window before it.

    The time a window before is looked up as a row of its own, in whatever slice it lies, so a window may hold many slices or a
    slice many windows."""
    at, keys = micros(F.col(ts)), list(keys)
    # Summed as decimals: the difference of two sums is exact wherever slices begin.
    totals = sliced.groupBy(*keys, "_slice", at.alias("_at")).agg(F.sum(F.col(value).cast("decimal(28,9)")).alias("_sum"))
    ends = totals.groupBy(*keys, "_slice").agg(F.sum("_sum").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_slice", F.sum("_sum").over(earlier).alias("_carry"))
    asked = (
        totals.select(*keys, F.col("_at").alias("_for"), (F.col("_at") - window_seconds * 1_000_000).alias("_at"))
        .join(cuts, keys, "left")
        .select(*keys, slice_of(F.col("_at")).alias("_slice"), "_at", F.lit(None).cast("decimal(38,9)").alias("_sum"), "_for")
    )
    both = totals.select(*keys, "_slice", "_at", F.col("_sum").cast("decimal(38,9)").alias("_sum"), F.lit(None).cast("long").alias("_for")).unionByName(asked)
    until = Window.partitionBy(*keys, "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    walked = both.withColumn("_until", F.sum("_sum").over(until)).join(carry, [*keys, "_slice"], "left")
    reached = F.coalesce("_until", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    parts = walked.select(*keys, F.coalesce("_for", "_at").alias("_at"), F.when(F.col("_for").isNull(), reached).otherwise(-reached).alias("_part"))
    sums = parts.groupBy(*keys, "_at").agg(F.sum("_part").cast("double").alias(name))
    return sliced.withColumn("_at", at).join(sums, [*keys, "_at"], "left").drop("_at")
