"""Collocations against their SQL; the trie and the tokens against plain Python."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from jobruns.llm import catalog, collocations, double_array


def test_all_keys_are_met_at_all_places():
    rng = random.Random(3)
    keys = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 9))) for _ in range(3000)} | {bytes([i, j]) for i in range(0, 256, 3) for j in range(256)})
    trie = double_array.build(keys)
    text = bytes(rng.choice(b"abcd") for _ in range(3000)) + b"\xff\xff"
    which, key, behind = trie.walk(np.frombuffer(text, np.uint8), np.arange(3000), np.zeros(3000, np.int32))
    got = sorted((int(w), int(b), keys[k]) for w, k, b in zip(which, key, behind, strict=True))
    known = set(keys)
    assert got == [(i, j, text[i:j]) for i in range(3000) for j in range(i + 1, min(i + 9, 3002)) if text[i:j] in known]
    assert trie.after(b"zz") == -1 or b"zz" in known


def test_no_keys():
    trie = double_array.build([])
    assert not len(trie.walk(np.frombuffer(b"ab\n", np.uint8), np.array([0, 1]), np.zeros(2, np.int32))[0])


@pytest.mark.parametrize("text", [b"a b. C\t d ..e f", b"", b"  ", b"x", b" x y ,", b"\n a  b", "É é,è".encode(), b"a\x0bb\x0cc\rd"])
def test_tokens(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
    pieces = [re.findall(rb"[^ \t]+", p) for p in re.split(rb"[.,;:!?\n-\r]", low)]
    out, first, end = collocations.tokens(text)
    assert [out[s:e].tobytes() for s, e in zip(first, end, strict=True)] == [w for p in pieces for w in p]
    assert [line.split(b" ") for line in out.tobytes().strip(b"\0").split(b"\n") if line] == [p for p in pieces if p]


def made(rng):
    words = ["a", "b", "c", "New", "york", "city", "é"]
    return [
        (rng.choice(["en", "de", None, "und", "x\ny", "\0"]), " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "!"]) for _ in range(rng.randrange(40))) if rng.random() < 0.95 else None)
        for _ in range(600)
    ]


@pytest.mark.parametrize("part, held", [(1 << 22, 300_000), (200, 50)])
def test_small_table_equals_sql(spark, monkeypatch, part, held):
    monkeypatch.setattr(collocations, "PART", part)
    monkeypatch.setattr(collocations, "HELD", held)
    rows = made(random.Random(3))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["lang", "text"]))
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS phrase").repartition(4)
    got = sorted(map(tuple, collocations.collocations(df).collect()))
    assert len(got) > 50 and got == sorted(con.execute(collocations.SQL).fetchall())


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_products_beyond_64_bits(spark):
    df = spark.sql("SELECT 9000000000000000000L AS a, 9000000000000000000L AS l, 9100000000000000000L AS r")
    exact = "(CAST(a AS DECIMAL(19, 0)) * 2000000) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))"
    assert df.selectExpr(f"{exact} AS score").first().score == 2_000_000 * 9 * 10**18 // (181 * 10**17)


def test_registered_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["op12_collocations"](spark, "/root/testdata/sf0.01").collect()))
    assert got == sorted(con.execute(collocations.SQL).fetchall())


def test_partitions_are_put_together_before_the_shuffle(spark):
    from jobruns.llm.collocations import _fewer

    cores = spark.sparkContext.defaultParallelism
    assert _fewer(spark.range(0, 1000, 1, 6 * cores)).rdd.getNumPartitions() == 3 * cores
    assert _fewer(spark.range(0, 1000, 1, cores)).rdd.getNumPartitions() == cores


def test_a_level_takes_one_walk_however_many_tries(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART", 20)
    monkeypatch.setattr(collocations, "BLOCK", 64)
    walked, walks = collocations._walked, []
    monkeypatch.setattr(collocations, "_walked", lambda *x: walks.append(len(x[1])) or walked(*x))
    rows = made(random.Random(5))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["lang", "text"]))
    got = sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(4)).collect()))
    assert len(walks) == collocations.LONGEST and max(walks) > 3
    assert len(got) > 50 and got == sorted(con.execute(collocations.SQL).fetchall())


@pytest.mark.parametrize("width, most", [(1, 255), (2, 65_535), (3, 1 << 24), (4, 2**31)])
def test_numbers_come_back_from_their_bytes(width, most):
    ids = np.random.default_rng(width).integers(0, most, 1000).astype(np.int32)
    assert (collocations._numbers(collocations._digits(ids, width).ravel(), width) == ids).all()


def test_rare_words_and_ends_of_pieces_are_one_zero():
    line = collocations._line(np.array([0, 5, 6, 0, 0, 7, 8, 9], np.int32), np.array([False, False, True, False, True, False, True, True]))
    assert line.tolist() == [5, 6, 0, 7, 8, 0, 9, 0]


@pytest.mark.parametrize("words", [2, 3, 4])
def test_phrases_of_numbers_are_counted(words):
    ids = np.random.default_rng(words).integers(2**31 - 4, 2**31 - 1, (words, 500)).astype(np.int32)
    want = Counter((*(int(x) for x in row), 0, 0)[:4] for row in ids.T)
    got = {(int(x >> 32), int(x & 0xFFFFFFFF), int(y >> 32), int(y & 0xFFFFFFFF)): int(n) for x, y, n in zip(*collocations._counted(list(ids)), strict=True)}
    assert got == want
    assert not len(collocations._counted([np.zeros(0, np.int32)] * words)[0])


def test_the_first_of_parts_hold_the_first_of_all(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TOP", 3)
    rows = made(random.Random(7))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["lang", "text"]))
    got = sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()))
    assert got == sorted(con.execute(collocations.SQL.replace("rank <= 2000", "rank <= 3")).fetchall())
