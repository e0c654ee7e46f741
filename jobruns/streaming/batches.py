"""Watermarks on UTC wall-clock times, folders with one sub-folder per micro-batch, and streams worked on key by key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobruns.functions.times import as_instant


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """``df`` with its time column as an instant under a watermark."""
    return df.withColumn(ts, as_instant(F.col(ts))).withWatermark(ts, delay)


#: Folders over which the rows of a batch are dealt by their keys.
BUCKETS = 16


def write_batch(df: DataFrame, path: str, batch_id: int, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str, first: int, last: int) -> DataFrame:
    """Rows written by the batches ``first`` to ``last``, with their ``batch_id``."""
    if last < first:
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("int"))
    rows = spark.read.schema(f"{schema}, batch_id INT").parquet(path)
    return rows.where(F.col("batch_id").between(first, last))


def start(
    stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict, mode: str = "append"
) -> StreamingQuery:
    """Run ``batch`` on every micro-batch; without a trigger, on all input there is and then stop."""

    def kept(rows: DataFrame, batch_id: int) -> None:
        # A batch is used several times; without this its source would be read each time.
        rows.persist()
        try:
            batch(rows, batch_id)
        finally:
            rows.unpersist()

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(kept)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def columns_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def start_per_key(
    stream: DataFrame,
    keys: Sequence[str],
    operator: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Keep the outcome of a batch operator that treats each key by itself, whatever order rows arrive in.

    A batch adds its rows to ``{path}/in``, in folders by a hash of the key, and works its keys out anew from all of their rows
    so far, for which it reads the folders of its own keys only; other keys keep the outcome they have. Nothing is too late: a row counts when it comes. ``{path}/out`` holds the
    outcomes by batch and ``{path}/keys`` the keys each batch worked on; :func:`current` puts them together. A batch
    that is run again replaces its own folders. Rows of a key can be taken out of ``{path}/in`` between
    runs when no more are expected.
    """
    schema = f"{columns_of(stream)}, _bucket INT"

    def batch(rows: DataFrame, batch_id: int) -> None:
        dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        write_batch(dealt.repartition("_bucket"), f"{path}/in", batch_id, ["_bucket"])
        touched = rows.select(*keys).distinct()
        own = [r._bucket for r in dealt.select("_bucket").distinct().collect()]
        log = read_batches(rows.sparkSession, f"{path}/in", schema, 0, batch_id)
        seen = log.where(F.col("_bucket").isin(own)).drop("batch_id", "_bucket")
        write_batch(operator(seen.join(touched, list(keys), "left_semi")), f"{path}/out", batch_id)
        write_batch(touched, f"{path}/keys", batch_id)

    return start(stream, batch, checkpoint, trigger)


def start_newest(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write what a grouped stream changes: each batch has the groups it touched, as they are after it. The groups are kept in
    Spark's own state, so a batch costs what it touches. :func:`newest` has all of them."""
    return start(stream, lambda rows, batch_id: write_batch(rows, f"{path}/out", batch_id), checkpoint, trigger, "update")


def newest(spark: SparkSession, path: str, keys: Sequence[str], schema: str, last: int) -> DataFrame:
    """The groups of :func:`start_newest` after batch ``last``."""
    out = read_batches(spark, f"{path}/out", schema, 0, last)
    columns = [c for c in out.columns if c != "batch_id"]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch_id").alias("_row")).select("_row.*")


def current(spark: SparkSession, path: str, keys: Sequence[str], schema: str, last: int) -> DataFrame:
    """What :func:`start_per_key` has for every key after batch ``last``. ``schema`` is that of the operator's result."""
    out = read_batches(spark, f"{path}/out", schema, 0, last)
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    touched = read_batches(spark, f"{path}/keys", ", ".join(f"`{k}` {kinds[k]}" for k in keys), 0, last)
    newest = touched.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return out.join(newest, [*keys, "batch_id"], "left_semi").drop("batch_id")
