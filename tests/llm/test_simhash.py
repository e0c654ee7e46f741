"""SimHash against plain Python over all pairs."""

import random

import numpy as np
import xxhash

from jobruns.llm.components import components
from jobruns.llm.simhash import compare, fingerprint, near_duplicates


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """The smallest id of each component, by closing over all pairs."""
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= radius and least[a] < least[b]:
                    least[b], changed = least[a], True
    return least


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    found = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in found.items()} == plain_components(prints)


def test_near_fingerprints_link_in_chains(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {}
    for b in base:
        p = b
        for _ in range(15):
            prints[len(prints)] = p
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                p ^= 1 << bit
    from jobruns.llm import simhash

    rows = [(i, 0, int(np.uint64(p).view(np.int64))) for i, p in prints.items()]
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: spark.createDataFrame(rows, "doc_id long, text_hash long, fp long"))
    monkeypatch.setattr(simhash, "BLOCK", 2)
    found = {r.doc_id: r.component_id for r in near_duplicates(None).collect()}
    assert found == plain_components(prints)


def test_compare_keeps_components_of_dense_blocks():
    a = np.arange(300, dtype=np.uint64)  # nine bits: all within chains of one bit
    u, v = compare(a, None)
    assert len(u) == 299 and set(v.tolist()) == {0}


def test_components_of_a_ring_and_a_hub(spark):
    ring = [(i, (i + 1) % 50) for i in range(50)]
    hub = [(1000, 1000 + i) for i in range(1, 80)]
    found = {r.u: r.v for r in components(spark.createDataFrame(ring + hub + [(7, 7)], "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(1, 50)}, **{1000 + i: 1000 for i in range(1, 80)}}


def test_odd_rows(odd, none):
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(odd).collect()]
    assert len(found) == odd.count()
    by_id = {i: (f, c) for i, f, c in found if i is not None}
    assert by_id[4] == by_id[5] == by_id[6] == ("0" * 16, 4)  # null, empty and blank texts
    assert by_id[1][1] == by_id[2][1] == by_id[3][1] == 1  # case and blanks do not count
    assert fingerprint(b"") == 0
    assert near_duplicates(none).count() == 0
