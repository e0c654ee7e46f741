"""Near duplicates by SimHash: fingerprints, tiles of them, and exact comparison of tiles.

A tile holds the distinct fingerprints with one population count in each 16-bit quarter. Two fingerprints
that differ in at most ``RADIUS`` bits have quarter counts that differ by at most ``RADIUS`` in sum, so all
other pairs of tiles are skipped. Tiles are cut into blocks of about ``BLOCK`` fingerprints; the pairs of
blocks that remain are compared in full with exclusive-or and bit counts. Of the links found in a pair
of blocks a spanning forest goes on, which keeps every component; the whole list is never formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobruns.llm.common import filled, table, text_hash, written
from jobruns.llm.components import components

WORDS, SEED, RADIUS = 3, 42, 3
BLOCK = 4096
#: Shingles hashed, and fingerprint pairs compared, at a time.
AT_ONCE = 1 << 17


def fingerprint(text: bytes) -> int:
    """Bit i is set if it is set in over half the hashes of the text's three-word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    counts, n = np.zeros(64, np.int64), 0
    while part := list(map(xxhash.xxh64_intdigest, islice(shingles, AT_ONCE), repeat(SEED))):
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) for every row; null texts count as empty."""
    slim = docs.select(
        F.col(key).cast("long").alias("doc_id"), text_hash(text).alias("text_hash"), filled(text).cast("binary").alias("text")
    )
    return slim.mapInArrow(_fingerprint_batches, "doc_id long, text_hash long, fp long")


QUARTERS = [f"q{i}" for i in range(4)]


def _steps() -> list[tuple[int, ...]]:
    """Differences of quarter counts that links can have, one of each pair of opposites, and none."""
    near = product(range(-RADIUS, RADIUS + 1), repeat=4)
    return [d for d in near if sum(map(abs, d)) <= RADIUS and d >= (0, 0, 0, 0)]


def blocks(prints: DataFrame) -> DataFrame:
    """(q0..q3, part, fps): the distinct fingerprints in blocks."""
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int").alias(q) for i, q in enumerate(QUARTERS)]
    tiled = prints.select("fp", *quarters)
    parts = tiled.groupBy(*QUARTERS).agg((F.floor(F.count(F.lit(1)) / F.lit(BLOCK)) + 1).alias("parts"))
    return (
        tiled.join(parts, QUARTERS)
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
        .groupBy(*QUARTERS, "part")
        .agg(F.collect_list("fp").alias("fps"))
    )


def _pairs(tiles: DataFrame) -> DataFrame:
    """Pairs of blocks that may hold links, by their keys, each once: (a, b), structs of quarters and part."""
    steps = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for d in _steps()]))
    near = tiles.withColumn("d", steps).select(
        F.struct(*QUARTERS, "part").alias("a"), *[(F.col(q) + F.col(f"d.d{i}")).alias(q) for i, q in enumerate(QUARTERS)]
    )
    other = tiles.select(*QUARTERS, F.struct(*QUARTERS, "part").alias("b"))
    return near.join(other, QUARTERS).select("a", "b").where("a <= b")


def _merged(roots: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots after linking u and v; a root is the smallest index of its component."""
    while True:
        a, b = roots[u], roots[v]
        apart = a != b
        if not apart.any():
            return roots
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(flat := roots[roots], roots):
            roots = flat


def compare(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of ``a`` and ``b`` (or within ``a``) as stars: (fingerprint, root)."""
    every = a if b is None else np.concatenate([a, b])
    right, at = (a, 0) if b is None else (b, len(a))
    roots, step = np.arange(len(every)), max(1, AT_ONCE * 4 // max(1, len(right)))
    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i : i + step, None] ^ right[None, :]) <= RADIUS
        u, v = np.nonzero(near)
        if len(u):
            roots = _merged(roots, u + i, v + at)
    inner = np.nonzero(roots != np.arange(len(roots)))[0]
    return every[inner], every[roots[inner]]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            a = batch.column(0)[i].values.to_numpy().view(np.uint64)
            right = batch.column(1)[i]
            u, v = compare(a, right.values.to_numpy().view(np.uint64) if right.is_valid else None)
            if len(u):
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def links(prints: DataFrame) -> DataFrame:
    """(u, v): links that join the same fingerprints into components as all pairs within the radius do."""
    tiles = written(blocks(prints), "tiles")
    keyed = tiles.select(F.struct(*QUARTERS, "part").alias("k"), "fps")
    pairs = _pairs(tiles.select(*QUARTERS, "part"))
    left = pairs.join(keyed.select(F.col("k").alias("a"), F.col("fps").alias("x")), "a")
    both = left.join(keyed.select(F.col("k").alias("b"), F.col("fps").alias("y")), "b")
    same = F.when(F.col("a") != F.col("b"), F.col("y"))
    return both.select("x", same.alias("y")).mapInArrow(_link_batches, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id, group) for every row.

    ``component_id`` is the smallest id reachable over links of fingerprints that differ in at most three bits
    (null where the component has no id); ``group`` is the same for the rows of a component and no others. Null and empty texts have fingerprint 0 and are linked like any
    other; repeated rows come back repeated; an empty frame gives an empty result.
    """
    docs = written(fingerprints(docs, key, text), "prints")
    prints = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(prints.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id", F.col("root").alias("group"))
    return docs.join(named, "fp").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group"
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")
