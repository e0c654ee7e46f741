"""Perfect hash tables, and deduplication against grouping in Python."""

import hashlib
import re

import numpy as np

from jobruns.llm import exact


def keys(n, salt=b""):
    return np.frombuffer(b"".join(hashlib.sha256(salt + str(i).encode()).digest() for i in range(n)), "<u8").reshape(-1, 4)


def test_perfect_hash_is_minimal_and_finds_members():
    for n in (1, 2, 63, 5000):
        words = keys(n)
        levels, slots = exact.perfect_hash(words)
        assert sorted(slots.tolist()) == list(range(n))
        assert exact.slots_of(words, levels).tolist() == slots.tolist()
        others = exact.slots_of(keys(1000, b"x"), levels)
        assert others.max() < n


def plain(rows):
    """(doc_id, keep_id, group_size, kept, sha) per row."""
    groups = {}
    for i, t in rows:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
        groups.setdefault(digest, []).append((-len(t or ""), i is None, i))
    out = []
    for digest, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(m[2], keep, len(members), m[2] == keep, digest) for m in members]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_odd_rows(odd, none):
    assert found(exact.dedup_documents(odd)) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert exact.dedup_documents(none).count() == 0


def test_any_split_into_history_and_arrivals_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(exact, "KEYS_PER_BUCKET", 7)
    rows = [(i, f"text {i % 40}" + " " * (i % 5)) for i in range(200)]
    all_keys = exact.digests(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    expected = plain(rows)
    for history in ("true", "false", "doc_id % 3 = 0"):
        assert found(exact.exact_dedup(all_keys.where(history), all_keys.where(f"NOT ({history})"))) == expected


def test_arrivals_are_dealt_over_buckets_without_a_history(spark, monkeypatch):
    monkeypatch.setattr(exact, "KEYS_PER_BUCKET", 10)
    dealt, merge = [], exact.merge_arrivals
    monkeypatch.setattr(exact, "merge_arrivals", lambda index, new, buckets: dealt.append(buckets) or merge(index, new, buckets))
    docs = [(None, f"text {i}") for i in range(200)], [(i or -(10**9), f"text {i}") for i in range(200)]
    for rows in docs:
        got = found(exact.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string")))
        assert got == plain(rows) and dealt.pop() == 21
