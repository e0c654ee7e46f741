"""Exact deduplication against a history held as minimal perfect hash tables.

The distinct digests of the history are dealt over buckets by hash. Each bucket becomes one row: a minimal
perfect hash function (levels of bit arrays; a key belongs to the first level where no other key takes its
bit, and its slot is the number of bits before it), and per slot the full digest and the winner's locator.
An arriving digest is looked up in its bucket; only if the slot's 32 bytes equal its own is it a repeat.
Digests that are not members are groups of their own.

Rows are grouped by digest before anything is shuffled by it, so a text that fills a third of the table is
one row per task; the buckets follow from the digests of history and arrivals together, so a bucket holds at most about
``KEYS_PER_BUCKET`` distinct digests however the rows are split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobruns.llm.common import SPACE, filled, table, text_hash, written

KEYS_PER_BUCKET = 20_000

GROUP = "digest binary, keep_id long, points long, group_size long"
INDEX = (
    "bucket long, level_sizes array<int>, level_bits array<binary>, digests binary, keep_ids array<long>, "
    "points array<long>, sizes array<long>"
)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, digest, points): SHA-256 of the text without blanks, and the text's code points."""
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        text_hash(text).alias("text_hash"),
        F.unhex(F.sha2(F.regexp_replace(filled(text), SPACE, "").cast("binary"), 256)).alias("digest"),
        F.char_length(filled(text)).cast("long").alias("points"),
    )


def groups(keys: DataFrame) -> DataFrame:
    """One row per digest: the row that stays (most code points, then smallest id, no id last) and the rows it stands for."""
    best = F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id")))
    return (
        keys.groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.col1")).alias("points"), "group_size")
    )


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys (rows of four 64-bit words of a digest) fall in a level of ``size`` bits."""
    mixed = np.full(len(words), 0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(words.shape[1]):
        mixed = (mixed ^ words[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
    return (mixed % np.uint64(size)).astype(np.int64)


def _words(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u8").reshape(-1, 4)


def perfect_hash(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels' bits, and for each key its slot (0 .. n-1, each once). Keys are distinct."""
    left, levels, slots, used = np.arange(len(words)), [], np.zeros(len(words), np.int64), 0
    while len(left):
        size = max(64, len(left) * 3 // 2)
        at = _places(words[left], len(levels), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        slots[left[alone]] = used + (np.cumsum(bits) - 1)[at[alone]]
        used += int(alone.sum())
        levels.append(bits)
        left = left[~alone]
    return levels, slots


def slots_of(words: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot a key would have: right for members, any slot or -1 for others."""
    out, left, used = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, bits in enumerate(levels):
        at = _places(words[left], level, len(bits))
        hit = bits[at]
        out[left[hit]] = used + (np.cumsum(bits) - 1)[at[hit]]
        used += int(bits.sum())
        left = left[~hit]
    return out


def _build(rows: pa.Table) -> pa.Table:
    packed = b"".join(rows["digest"].to_pylist())
    levels, slots = perfect_hash(_words(packed))
    order = pa.array(np.argsort(slots))
    in_slots = rows.take(order)
    return pa.table(
        {
            "bucket": [rows["bucket"][0].as_py()],
            "level_sizes": pa.array([[len(b) for b in levels]], pa.list_(pa.int32())),
            "level_bits": pa.array([[np.packbits(b).tobytes() for b in levels]], pa.list_(pa.binary())),
            "digests": pa.array([b"".join(in_slots["digest"].to_pylist())], pa.binary()),
            "keep_ids": pa.array([in_slots["keep_id"].to_pylist()], pa.list_(pa.int64())),
            "points": pa.array([in_slots["points"].to_pylist()], pa.list_(pa.int64())),
            "sizes": pa.array([in_slots["group_size"].to_pylist()], pa.list_(pa.int64())),
        }
    )


def _better(a: tuple, b: tuple) -> bool:
    """Does (points, id) ``a`` go before ``b``?"""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


def _merge(index: pa.Table, arrivals: pa.Table) -> pa.Table:
    """Every group of the bucket, with the arrivals that repeat a member counted in and those that do not beside it."""
    held = {n: [] for n in ("digest", "keep_id", "points", "group_size")}
    levels: list[np.ndarray] = []
    if index.num_rows:
        row = index.to_pylist()[0]
        packed = row["digests"]
        levels = [
            np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
            for b, n in zip(row["level_bits"], row["level_sizes"], strict=True)
        ]
        held = {
            "digest": [packed[i : i + 32] for i in range(0, len(packed), 32)],
            "keep_id": row["keep_ids"],
            "points": row["points"],
            "group_size": row["sizes"],
        }
    if arrivals.num_rows:
        new = {n: arrivals[n].to_pylist() for n in held}
        slots = slots_of(_words(b"".join(new["digest"])), levels) if levels else [-1] * arrivals.num_rows
        for i, slot in enumerate(slots):
            if slot < 0 or held["digest"][slot] != new["digest"][i]:
                for n in held:
                    held[n].append(new[n][i])
                continue
            held["group_size"][slot] += new["group_size"][i]
            if _better((new["points"][i], new["keep_id"][i]), (held["points"][slot], held["keep_id"][slot])):
                held["points"][slot], held["keep_id"][slot] = new["points"][i], new["keep_id"][i]
    kinds = {"digest": pa.binary(), "keep_id": pa.int64(), "points": pa.int64(), "group_size": pa.int64()}
    return pa.table({n: pa.array(held[n], kinds[n]) for n in held})


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket of the groups of the history (columns of ``GROUP``)."""
    return _bucketed(history, buckets).groupBy("bucket").applyInArrow(_build, INDEX)


def merge_arrivals(index: DataFrame, arrivals: DataFrame, buckets: int) -> DataFrame:
    """Groups of history and arrivals together; ``buckets`` must be the number the index was built with."""
    return (
        index.groupBy("bucket")
        .cogroup(_bucketed(arrivals, buckets).groupBy("bucket"))
        .applyInArrow(_merge, GROUP)
    )


def exact_dedup(history: DataFrame, arrivals: DataFrame) -> DataFrame:
    """One row per row of either frame of ``digests``: its columns but the digest, keep_id, group_size, kept and text_sha256.

    A null text counts as empty. ``kept`` marks rows with the id of the row that stays: rows repeated with
    their id are one document, and all of them are marked. A row without id stays only if no row of its
    group with as many code points has one. Empty frames give an empty result.
    """
    old = written(groups(history), "history")
    new = written(groups(arrivals), "arrivals")
    buckets = (old.count() + new.count()) // KEYS_PER_BUCKET + 1
    index = written(build_index(old, buckets), "index")
    found = merge_arrivals(index, new, buckets)
    keys = history.unionByName(arrivals)
    return keys.join(found.select("digest", "keep_id", "group_size"), "digest").select(
        "doc_id",
        "text_hash",
        "points",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``exact_dedup`` of one table: half of its ids, by hash, are the history, the rest arrives."""
    keys = written(digests(docs, key, text), "digests")
    known = F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    return exact_dedup(keys.where(known), keys.where(~known))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS text_sha256
  FROM documents)
, g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
