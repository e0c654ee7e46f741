"""Searches against all products."""

import numpy as np

from jobruns.llm import mtree


def brute(ids, x, q, own, k):
    scores = x @ q
    rows = [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != own]
    return [(-s, -i) for s, i in sorted(rows)[:k]]


def test_trees_find_the_best_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (12, 6))
    x = np.concatenate([c + rng.integers(-15, 16, (400, 6)) for c in centres] + [np.tile(centres[0], (300, 1))])
    ids = rng.permutation(len(x)) * 3
    tree = mtree.Tree(x, ids, int((x * x).sum(1).max()))
    for i in range(0, len(x), 97):
        assert tree.search(x[i], int(ids[i]), 20) == brute(ids, x, x[i], ids[i], 20)
    assert tree.computed < 0.8 * len(x) * len(range(0, len(x), 97))
    assert len(tree.search(x[0], -1, 10_000)) == len(x)


def test_exact_products_of_large_components():
    x = np.array([[2**28 + i, -(2**28) + 2 * i] for i in range(50)])
    tree = mtree.Tree(x, np.arange(50), int((x * x).sum(1).max()))
    assert tree.search(x[3], 3, 20) == brute(np.arange(50), x, x[3], 3, 20)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 40)
    monkeypatch.setattr(mtree, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), 1, "x") for i in range(150)]
    rows += [(200, None, 1, "x"), (220, [1.0, None], 1, "x"), (240, [float("nan")] * 8, 1, "x"), (260, [float("inf")] * 8, 1, "x")]
    rows += [(280, [0.5, -0.5], 1, "x"), (300, [], 1, "x"), (None, [1.0] * 8, 1, "x")]
    rows += [(400 + i, rows[20][1], 1, "x") for i in range(45)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long, rank string")
    vectors = mtree.quantised(df)
    found = {}
    for r in mtree.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.score, -r.vec_id)
    known = {r.vec_id: r.v + [0] * (8 - len(r.v)) for r in vectors.collect()}
    ids, x = np.array(list(known)), np.array(list(known.values()))
    assert set(found) == {i for i in known if i % 20 == 0} and not {200, 220, 240, 260} & set(known)
    for q, ranks in found.items():
        assert [ranks[i] for i in range(1, 21)] == brute(ids, x, np.array(known[q]), q, 20)
    few = vectors.where("vec_id < 5")
    assert mtree.top_k(few, few.where("vec_id = 0")).count() == 4
    assert mtree.top_k(few.where("false"), few.where("false")).count() == 0
