"""The trie of rebuilt conversations against one built in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from jobruns.llm import catalog, prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, line in own.items():
        h, giver = zlib.crc32(str(c).encode()) % 9, c - c % 5
        paths[c] = line if giver == c else own.get(giver, [])[:h] + line[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, line in paths.items():
        for d in range(len(line) + 1):
            members[tuple(line[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    def subtree(k):
        leaves = 0 if children[k] else 1
        saved = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        for child in children[k]:
            more, bytes_ = subtree(child)
            leaves, saved = leaves + more, saved + bytes_
        return leaves, saved

    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(paths[c]) == len(k)))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), len(children[k]), *subtree(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df):
    return sorted(map(tuple, prefix_trie.prefix_trie(df).select(NAMES).collect()), key=str)


@pytest.mark.parametrize("block, turns", [(4, 1024), (3, 2)])
def test_odd_conversations(spark, monkeypatch, block, turns):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "TURNS", turns)
    rng, rows = random.Random(2), []
    for c in [*range(60), 10**15 + 1]:
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 2, 3, 5, 9, 14, 30])):
            rows.append((
                c if rng.random() < 0.98 else None, t if rng.random() < 0.9 else None,
                rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user",
                rng.choice(["a", "é", "", None, "x" * 5000]) if rng.random() < 0.3 else "x",
            ))
    rows += rows[:10]  # rows repeated whole
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS digest", "2 AS b", "3 AS conv").repartition(5)
    assert nodes(df) == plain(rows)


def test_no_conversations_no_nodes(spark):
    assert nodes(spark.createDataFrame([], COLUMNS)) == []
    assert nodes(spark.createDataFrame([(None, 1, "user", "a")], COLUMNS)) == []


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    # 38 takes 8 turns from 35, which is not there, in place of its own first 8.
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 200) if c % 5}
    bare = next(c for c, n in h.items() if n >= 1)
    assert nodes(spark.createDataFrame([(bare, 0, "user", "a")], COLUMNS)) == plain([(bare, 0, "user", "a")])


def test_registered_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    expected = con.execute(f"SELECT {', '.join(NAMES)} FROM ({prefix_trie.SQL})").fetchall()
    got = catalog.QUERIES["op11_prefix_trie"](spark, "/root/testdata/sf0.01").select(NAMES).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
