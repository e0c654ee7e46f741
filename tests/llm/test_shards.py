"""Exact sizes, gapless slots, and the laws of the draws."""

from collections import Counter
from math import comb
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from jobruns.llm import shards


@pytest.mark.parametrize("pop, good, draws", [(20, 7, 9), (50, 1, 49), (10, 10, 4), (12, 0, 5), (9, 5, 9), (30, 15, 0), (400, 130, 90)])
def test_quantiles_of_the_hypergeometric_law(spark, pop, good, draws):
    lo, hi = max(0, draws - (pop - good)), min(good, draws)
    law = {x: comb(good, x) * comb(pop - good, draws - x) / comb(pop, draws) for x in range(lo, hi + 1)}
    n = 4000
    args = [F.lit(v).cast("long") for v in (pop, good, draws)]
    found = spark.range(n).select(shards.hypergeometric(*args, (F.col("id") + 0.5) / n).alias("x")).groupBy("x").count()
    got = {r.x: r["count"] / n for r in found.collect()}
    assert set(got) <= set(law)
    for x, p in law.items():
        assert got.get(x, 0) == pytest.approx(p, abs=1.01 / n)


def test_large_populations_keep_their_moments(spark):
    pop, good, draws, n = 45_000_000_000, 5_625_000_000, 16_384, 2000
    args = [F.lit(v).cast("long") for v in (pop, good, draws)]
    x = shards.hypergeometric(*args, (F.col("id") + 0.5) / n).alias("x")
    mean, var = spark.range(n).select(x).agg(F.avg("x"), F.variance("x")).first()
    assert mean == pytest.approx(draws / 8, abs=1) and var == pytest.approx(draws / 8 * 7 / 8, rel=0.02)


def test_matrix_has_the_margins(spark):
    rows = [(p, (p * 7919) % 300) for p in range(37) if p % 5]
    matrix = shards.communication_matrix(spark.createDataFrame(rows, "part long, rows long"), 8, 1).collect()
    got = {r.part: r.counts for r in matrix}
    assert {p: sum(c) for p, c in got.items()} == {p: n for p, n in rows if n}
    total, sums = sum(n for _, n in rows), [sum(c[s] for c in got.values()) for s in range(8)]
    assert sums == [total // 8 + (s < total % 8) for s in range(8)]


def deal(df, **kw):
    return [(r.shard, r.slot, r.k) for r in shards.uniform_shards(df.withColumn("shard", F.lit(-1)), **kw).collect()]


def test_sizes_slots_and_mixing(spark):
    df = spark.range(5003).select(F.col("id").alias("k"))
    dealt = deal(df, rows_per_partition=150)
    assert sorted(k for _, _, k in dealt) == list(range(5003))
    sizes = Counter(s for s, _, _ in dealt)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(slot for t, slot, _ in dealt if t == s) == list(range(n))
    # Neighbours in the input are together in a shard as often as chance has it.
    shard = {k: s for s, _, k in dealt}
    together = sum(shard[k] == shard[k + 1] for k in range(5002)) / 5002
    assert together == pytest.approx(1 / 8, abs=0.02)
    place = {k: slot for _, slot, k in dealt}
    assert sum(place[k] for k in range(2500)) / 2500 == pytest.approx(312, abs=12)
    assert deal(df, rows_per_partition=150) == dealt or sorted(deal(df, rows_per_partition=150)) == sorted(dealt)
    assert sorted(deal(df, rows_per_partition=150, seed=77)) != sorted(dealt)


def test_odd_rows(odd, none):
    found = shards.uniform_shards(odd, shards=4).collect()
    assert sorted(Counter(r.shard for r in found).values()) == [3, 3, 3, 4]
    assert set(found[0].asDict()) == {*odd.columns, "shard", "slot"}
    assert shards.uniform_shards(none).count() == 0


def test_rows_that_repeat_more_than_a_partition_holds(spark):
    """A third of all rows are one row; they are numbered and dealt apart, and each comes back."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.lit(None).cast("string").alias("t"))
    found = shards.uniform_shards(df, rows_per_partition=100).collect()
    assert Counter(r.k for r in found) == Counter(r.k for r in df.collect())
    assert sorted((r.shard, r.slot) for r in found) == [(s, i) for s in range(8) for i in range(375)]
    hot = Counter(r.shard for r in found if r.k == -1)
    assert min(hot[s] for s in range(8)) > 80 and max(hot.values()) < 170


def test_query_deals_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = shards.op9_shards(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in found} == {k: (len(t) + 1, crc32(t)) for k, t in docs.items()}
    sizes = Counter(r.shard for r in found)
    assert len(found) == len(docs) and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in found) == [(s, i) for s in sorted(sizes) for i in range(sizes[s])]
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
