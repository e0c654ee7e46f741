"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobruns.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return (
        edges.join(least, "u")
        .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .where("u > v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that is not the smallest of its component, and that smallest node.

    ``edges`` has columns u and v of one comparable type. Loops are left out. Each round is one written table;
    the number of rounds grows with the logarithm of the nodes. Nodes without links are not returned. Sums
    are formed before rows are dealt by node, and the joins are plain, so that a hub is split by adaptive
    execution.
    """
    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    was, step = None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was or not mark[0]:
            return now
        was, step = mark, step + 1
        now = written(_small_star(_large_star(now)), f"stars-{step}")
