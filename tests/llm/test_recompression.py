"""Repeated windows against a dictionary of all windows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from jobruns.llm import catalog, recompression

WINDOW = recompression.WINDOW


def plain(rows):
    first = {}
    order = lambda i: recompression.LAST if i is None else i
    for i, text in rows:
        words = (text or "").encode().split()
        for p in range(len(words) - WINDOW + 1):
            key = tuple(words[p : p + WINDOW])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - WINDOW + 1):
            if first[tuple(words[p : p + WINDOW])] < order(i):
                gone[p : p + WINDOW] = [True] * WINDOW
        left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    """Texts of few and of many different words, with passages of each other, runs, nulls, ids that repeat or are null."""
    rng, rows = random.Random(seed), []
    for n in range(110):
        many = rng.choice([1, 2, 3, 8, 50])
        words = [f"w{rng.randrange(many)}" for _ in range(rng.randrange(120))]
        if rows and rng.random() < 0.6:
            other = (rng.choice(rows)[1] or "").split()
            a = rng.randrange(len(other) + 1)
            words[len(words) // 2 : len(words) // 2] = other[a : a + rng.randrange(5, 60)]
        rows.append((rng.choice([None, n, n, n, n // 2]), rng.choice([" ", "\t\n "]).join(words) if rng.random() < 0.95 else None))
    return rows + rows[:5]


@pytest.mark.parametrize("seed, at_once", [(1, 200_000), (2, 100)])
def test_odd_texts(spark, monkeypatch, seed, at_once):
    monkeypatch.setattr(recompression, "AT_ONCE", at_once)
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS place", "3 AS anchor").repartition(5)
    got = sorted(map(tuple, recompression.without_repeats(df).collect()), key=str)
    assert got == plain(rows) and sum(r[2] for r in got) > 1000


def test_a_very_long_text_and_many_copies(spark):
    rng = random.Random(9)
    long = " ".join(f"v{rng.randrange(30_000)}" for _ in range(60_000))
    rows = [(7, long), (3, " ".join(long.split()[20_000:20_050]))] + [(100 + i, "same " * 40 + "end") for i in range(200)]
    got = sorted(map(tuple, recompression.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain(rows)


def test_empty_table(spark):
    assert recompression.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    for _ in range(60):
        many = rng.choice([1, 2, 3, 8, 50])
        word = lambda m=many: f"w{rng.randrange(m)}".encode()
        passage = [word() for _ in range(rng.randrange(13, 40))]
        texts = [[word() for _ in range(rng.randrange(30))] + passage + [word() for _ in range(rng.randrange(30))] for _ in range(4)]
        words = [w for t in texts for w in t]
        first = np.zeros(len(words), bool)
        first[np.cumsum([0] + [len(t) for t in texts[:-1]])] = True
        seen, windows = {}, 0
        for anchor, start, count, _ in zip(*recompression.stretches(recompression.word_hashes(words), first), strict=True):
            for k in range(int(count)):
                assert seen.setdefault(tuple(words[start + k : start + k + WINDOW]), anchor) == anchor
                windows += 1
        assert windows == sum(max(0, len(t) - WINDOW + 1) for t in texts)


def test_registered_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["op13_recompression"](spark, "/root/testdata/sf0.01").collect()))
    assert got == sorted(con.execute(recompression.SQL).fetchall())
