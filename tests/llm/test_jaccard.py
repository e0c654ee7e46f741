"""Near copies against brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from jobruns.llm import common, jaccard

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_pairs(texts):
    sets = {i: plain_set(t) for i, t in texts.items()}
    return [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def made(rng):
    """Texts with words changed, dropped and added, from a few of them to many, and texts that share a long passage."""
    word = lambda: f"w{rng.randrange(5000)}"
    passage, texts = [word() for _ in range(60)], {}
    for base in range(12):
        first = [word() for _ in range(rng.choice([4, 12, 80, 300]))]
        for copy in range(8):
            now = list(first)
            for _ in range(copy * len(first) // 250 + (copy > 5)):
                at = rng.randrange(len(now))
                now[at : at + 1] = rng.choice([[], [word()], [now[at], word()]])
            texts[len(texts)] = " ".join(now)
    for _ in range(40):
        texts[len(texts)] = " ".join(passage + [word() for _ in range(rng.choice([5, 40]))])
    return texts


def test_every_similar_pair_is_in_one_group(spark, monkeypatch):
    texts = made(random.Random(5))
    pairs = plain_pairs(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "FEW", 4)  # larger groups are compared by representatives, then block by block
    monkeypatch.setattr(jaccard, "REPS", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    group = {r.doc_id: r.group for r in jaccard.near_copies(docs).collect()}
    assert set(group) == set(texts)
    assert len(pairs) > 60 and all(group[a] == group[b] for a, b in pairs)


def test_pair_that_differs_in_many_bits_goes_in_the_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id IN (0, 7818)")
    assert [r.doc_id for r in corpus_pipeline.different(spark, docs, "").collect()] == [0]


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    common = np.sort(rng.integers(0, 400, 60).astype(np.uint64))
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.12], rng.integers(0, 400, 2).astype(np.uint64)]))
        if jaccard.jaccard(a, b) >= jaccard.LEAST:
            assert set(jaccard.prefix(a, np.unique(common))) & set(jaccard.prefix(b, np.unique(common)))


def test_a_group_that_shares_one_shingle_takes_a_fixed_number_of_tables(spark, monkeypatch):
    rng, tables = random.Random(6), []
    write = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, label: tables.append(label) or write(df, label))
    monkeypatch.setattr(jaccard, "SAMPLE", 1)  # as a rare shingle looks in a large corpus
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = [(i, " ".join(["one", "passage", "of", "five", "words"] + [word() for _ in range(30)])) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert jaccard.near_copies(docs).select("group").distinct().count() == 400
    assert len(tables) <= 20


def test_profiles_bound_what_sets_share():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 300), np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.3], rng.integers(0, 2**64, rng.integers(0, 30), np.uint64)]))
        if jaccard.jaccard(a, b) >= jaccard.LEAST:
            assert jaccard.allowed(jaccard.profile(a), len(a), jaccard.profile(b), len(b))


def test_odd_rows_and_an_empty_table(odd, none):
    assert jaccard.near_copies(none).count() == 0
    rows = jaccard.near_copies(odd).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.group, []).append(str(r.doc_id))
    assert len(rows) == odd.count()
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [["1", "2", "2", "3"], ["4", "5", "6", "None"], ["None"], ["7"], ["8"], ["9"], ["10"]]))


def test_a_task_holds_one_python_worker(spark, monkeypatch):
    """Packing texts and forming their sets are stages apart, even where the texts asked for are few enough to be broadcast."""
    plans = {}

    def written(df, label, plain=jaccard.written):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(jaccard, "written", written)
    texts = ["a b c d e f g h", "a b c d e f g h i", "something else of more than five words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    jaccard.near_copies(docs).collect()
    assert plans["shingles"].count("MapInArrow") == 2 and "SortMergeJoin" in plans["shingles"] and "Broadcast" not in plans["shingles"]


def test_python_gets_batches_of_few_bytes(spark, monkeypatch):
    """Pairs of long texts carry two shingle sets each: by rows, or by Spark's own limit, a batch of them is large."""
    limit, steps = 100_000, ["_packed", "_set_batches", "_allowed_batches", "_near_batches", "_across_batches"]

    def held(plain):
        def batches(parts):
            def seen():
                for part in parts:
                    if part.num_rows > 1 and part.nbytes > 2 * limit:
                        raise ValueError(f"a batch of {part.nbytes} bytes")
                    yield part

            yield from plain(seen())

        return batches

    for step in steps:
        monkeypatch.setattr(jaccard, step, held(getattr(jaccard, step)))
    monkeypatch.setattr(common, "BATCH", limit, raising=False)
    before = spark.conf.get(KEY)
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join([*words[:i], "other", *words[i + 1 :]])) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert jaccard.near_copies(docs).select("group").distinct().count() == 1
    assert spark.conf.get(KEY) == before


def test_small_batches_end_with_an_error(spark):
    before = spark.conf.get(KEY)
    with pytest.raises(ValueError), common.small_batches(spark):
        assert spark.conf.get(KEY) == str(common.BATCH) != before
        raise ValueError
    assert spark.conf.get(KEY) == before
