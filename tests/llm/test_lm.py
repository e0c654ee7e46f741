"""Base scores against plain Python, scores as a distribution, and held-out likelihood."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from jobruns.llm import lm


def tokens(text):
    return [*("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()), "end"]


def plain(rows):
    c = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            c.update(tokens(t))
    n, v = c.total(), len(c)
    return c, {
        (i, t): (len(w := tokens(t)), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        for i, t in rows
    }


def test_given_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 2000)  # so that most words are joined
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, expected = plain(rows)
    texts = dict(rows)
    found = lm.lm_scores(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        n, known, total, base = expected[r.doc_id, texts[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    """Over all known words, the end, and one unseen word of each class, after any class."""
    rows = [(i, " ".join(f"w{(i * j) % 700}x{j % 3}" for j in range(60))) for i in range(80)]
    slim = lm._slim(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    counts = lm.word_counts(slim)
    model = lm.fit(slim, counts)
    p = 10 ** model.table
    assert np.allclose(p.sum(1), 1)
    own = np.zeros(lm.CLASSES)
    for r in counts.collect():
        c = model.vocab.class_of(bytes(r.word))
        own[c] += 1.0 if c <= lm.HEADS else (r.n + 0.1) / 10 ** model.masses[c]
    own[lm.END] = 1
    for c in range(1 + lm.HEADS, lm.CLASSES):
        own[c] += 0.1 / 10 ** model.masses[c]
    used = own > 0  # an unused class of one word is no word
    assert np.allclose(own[used], 1)


def test_odd_rows(odd, none, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    _, expected = plain(rows)
    found = lm.lm_scores(odd).collect()
    got = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found)
    assert got == Counter((i, n, k, round(b, 6)) for i, t in rows for n, k, _, b in [expected[i, t]])
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert len({r.score for r in found if r.doc_id == 2}) == 1
    assert lm.lm_scores(none).count() == 0
    only_held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    unseen = lm.lm_scores(spark.createDataFrame([(i, "never seen") for i in only_held], "doc_id long, text string")).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in unseen} == {(0, 0, 0.0)}
