"""Reading the given tables, and tables written in the shared folder between steps."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobruns.session import shared_dir

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that a Python worker is given at a time within ``small_batches``; a longer row comes alone.
BATCH = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors reach."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{label}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and any executor can read it again."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let go of what earlier steps shuffled: Spark removes the files of plans that the driver's collectors find gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile goes to Python in batches of about ``BATCH`` bytes, whatever the rows hold.

    A task holds a batch several times over: in Arrow's vectors, in the stream to the worker, and in the worker. By
    Spark's own limit of 64 MB that is some hundred megabytes beside the heap.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def filled(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_hash(text: str = "text") -> Column:
    """A hash of the whole text; with the id it names a row, whatever else repeats."""
    return F.xxhash64(filled(text))


def id_bucket(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(filled(F.col(key).cast("string")).cast("binary")), F.lit(n))
