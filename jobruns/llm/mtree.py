"""Exact top-k by inner product with M-trees.

Vectors are dealt over trees by hash, about ``TREE`` to each, so that equal vectors do not meet in one place. With
one more component that gives all vectors the norm of the longest, distance is a metric whose nearest are
the largest inner products. A tree is built in one task: pages of entries with the distance to their page's
routing object, covering radii, and routing objects that know the distance to their own parent. A query
visits pages best first. By the triangle inequality the stored distances bound an entry's distance from the
parent's alone, and what cannot beat the k-th best is left without working out its distance.

Trees and blocks of queries are joined by tree; of each tree a query keeps its k best, and the k best of those
are the result. Scores are integers and worked out exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobruns.llm.common import table, written

TREE, PAGE, FANOUT, QUERIES = 16_384, 1024, 16, 512
SCALE, TOP, EVERY = 64, 20, 20
#: Added to bounds: distances are rounded, scores are not.
SLACK = 1e-6


@dataclass
class Page:
    """A node: its routing object's distance bounds, and its entries (pages, or rows of the tree's vectors)."""

    centre: np.ndarray
    radius: float
    to_parent: float
    rows: np.ndarray | None  # of a leaf
    to_centre: np.ndarray  # of the leaf's rows
    pages: list[Page]
    first: int = 0  # where the leaf's rows begin in the tree's order


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(points - centre).sum(1))


def build(points: np.ndarray, rows: np.ndarray, centre: np.ndarray, parent: np.ndarray) -> Page:
    """The page of ``rows`` around ``centre``, filled from the top: rows go to the nearest of some routing objects."""
    own = _distances(points[rows], centre)
    radius, to_parent = float(own.max(initial=0.0)), float(np.sqrt(np.square(centre - parent).sum()))
    if len(rows) <= PAGE or radius == 0.0:
        return Page(centre, radius, to_parent, rows, own, [])
    # Routing objects far from each other: each next one is the row farthest from those there are.
    chosen, near, part = [], np.full(len(rows), np.inf), np.zeros(len(rows), int)
    at = int(own.argmax())
    for i in range(min(FANOUT, len(rows) // PAGE + 1)):
        chosen.append(rows[at])
        d = _distances(points[rows], points[rows[at]])
        part[d < near] = i
        near = np.minimum(near, d)
        at = int(near.argmax())
        if near[at] == 0.0:
            break
    pages = [build(points, rows[part == i], points[c], centre) for i, c in enumerate(chosen)]
    return Page(centre, radius, to_parent, None, np.zeros(0), pages)


class Tree:
    """An M-tree over integer vectors and their ids; ``peak`` is the largest squared norm of all trees."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, peak: int) -> None:
        self.vectors, self.ids, self.peak = vectors, ids, peak
        # Products of doubles are exact below 2**53, and no partial sum is larger than the norms' product.
        self.exact = vectors.astype(np.float64) if peak < 1 << 52 else vectors
        flat = vectors.astype(np.float64)
        lift = np.sqrt(np.maximum(float(peak) - np.square(flat).sum(1), 0.0))
        self.points = np.column_stack([flat, lift])
        mean = self.points.mean(0)
        root = self.points[int(_distances(self.points, mean).argmin())]
        self.root = build(self.points, np.arange(len(ids)), root, root)
        order: list[np.ndarray] = []
        self._arrange(self.root, order, 0)
        rows = np.concatenate(order)
        self.exact, self.ids = np.ascontiguousarray(self.exact[rows]), ids[rows]
        self.computed = 0

    def _arrange(self, page: Page, order: list[np.ndarray], used: int) -> int:
        """Leaves one after the other, so that a leaf is read as one slice."""
        if page.rows is None:
            for child in page.pages:
                used = self._arrange(child, order, used)
            return used
        page.first = used
        order.append(page.rows)
        return used + len(page.rows)

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, -id), best first, without the row of id ``own``."""
        exact = query.astype(self.exact.dtype)
        lifted = np.append(query.astype(np.float64), 0.0)
        norms = float(np.square(lifted).sum()) + float(self.peak)
        best: list[tuple[int, int]] = []
        limit = np.inf

        def distance(centre: np.ndarray) -> float:
            self.computed += 1
            return float(np.sqrt(np.square(lifted - centre).sum()))

        first = distance(self.root.centre)
        queue, n = [(max(0.0, first - self.root.radius), 0, first, self.root)], 0
        while queue:
            bound, _, from_centre, page = heapq.heappop(queue)
            if bound > limit:
                break
            if page.rows is None:
                for child in page.pages:
                    if abs(from_centre - child.to_parent) - child.radius > limit:
                        continue
                    d = distance(child.centre)
                    if d - child.radius <= limit:
                        n += 1
                        heapq.heappush(queue, (max(0.0, d - child.radius), n, d, child))
                continue
            rows = slice(page.first, page.first + len(page.rows))
            if limit < np.inf:
                hopeful = np.nonzero(np.abs(page.to_centre - from_centre) <= limit)[0]
                if len(hopeful) < len(page.rows) // 2:
                    rows = hopeful + page.first
            scores, ids = self.exact[rows] @ exact, self.ids[rows]
            self.computed += len(ids)
            keep = ids != own
            scores, ids = scores[keep], ids[keep]
            if len(best) == k:
                better = scores >= best[-1][0]
                scores, ids = scores[better], ids[better]
            if not len(scores):
                continue
            if len(scores) > k:
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
            best = sorted(best + [(int(s), -int(i)) for s, i in zip(scores, ids, strict=True)], reverse=True)[:k]
            if len(best) == k:
                limit = np.sqrt(max(norms - 2.0 * best[-1][0], 0.0)) * (1 + 1e-9) + SLACK
        return best


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(64 * x) of each component. Vectors that are null or have a null or non-finite component,
    and rows without an id, take no part."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        rows.where(x.isNotNull() & F.coalesce(fine, F.lit(False)) & F.col(key).isNotNull())
        .select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of one width; shorter ones are filled with zeros."""
    flat = column.combine_chunks()
    out = np.zeros((len(flat), width), np.int64)
    sizes = np.diff(flat.offsets.to_numpy())
    out[np.arange(width) < sizes[:, None]] = flat.flatten().to_numpy()
    return out


def packed(vectors: DataFrame, by: str, width: int) -> DataFrame:
    """One row per value of ``by``: its ids and vectors as bytes (little-endian 64-bit numbers)."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        return pa.table(
            {
                by: [rows[by][0].as_py()],
                "ids": [rows["vec_id"].to_numpy().astype("<i8").tobytes()],
                "matrix": [_matrix(rows["v"], width).astype("<i8").tobytes()],
            }
        )

    return vectors.groupBy(by).applyInArrow(pack, f"{by} long, ids binary, matrix binary")


def _searched(width: int, peak: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                number, ids, matrix, query_ids, queries = (c[i].as_py() for c in batch.columns)
                if at != number:
                    ids = np.frombuffer(ids, "<i8")
                    at, tree = number, Tree(np.frombuffer(matrix, "<i8").reshape(len(ids), width), ids, peak)
                query_ids = np.frombuffer(query_ids, "<i8")
                found = [
                    (int(q), -minus, score)
                    for q, v in zip(query_ids, np.frombuffer(queries, "<i8").reshape(len(query_ids), width), strict=True)
                    for score, minus in tree.search(v, int(q), k)
                ]
                rows = np.array(found, np.int64).reshape(-1, 3)
                yield pa.record_batch([pa.array(rows[:, j]) for j in range(3)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors with the largest inner products, ties to smaller ids.

    Both frames have columns vec_id and v (``quantised``). A query's own id is not among its results. Vectors of
    different lengths are compared as if filled up with zeros. Fewer than k candidates give fewer rows; empty
    frames give none. A row repeated whole is a candidate as often as it is there.
    """
    vectors = written(vectors, "vectors")
    squares = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    n, width, peak = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(squares), F.lit(0))).first()
    trees = n // TREE + 1
    dealt = vectors.withColumn("tree", F.pmod(F.xxhash64("vec_id"), F.lit(trees)))
    blocks = queries.count() // QUERIES + 1
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)))
    asked = packed(asked, "block", width).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))).alias("tree"),
        F.col("ids").alias("query_ids"),
        F.col("matrix").alias("queries"),
    )
    pairs = packed(dealt, "tree", width).join(asked, "tree").select("tree", "ids", "matrix", "query_ids", "queries")
    found = pairs.mapInArrow(_searched(width, peak, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
, s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
