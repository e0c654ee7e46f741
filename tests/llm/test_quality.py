"""Held-out accuracy, and the contract of scores."""

import zlib

from jobruns.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    found = {r.doc_id: r for r in quality.rated(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in found.items())
    assert all(r.predicted == (r.score >= 0.3) for r in found.values())
    held = [(r.quality, found[r.doc_id]) for r in labels.collect() if found[r.doc_id].held_out]
    good, bad = ([f for q, f in held if q == want] for want in (1, 0))
    assert len(good) > 30 and len(bad) > 5
    assert sum(f.predicted for f in good) / len(good) > 0.95
    assert sum(f.predicted for f in bad) / len(bad) < 0.3
    pairs = [(g.score > b.score) + 0.5 * (g.score == b.score) for g in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.9


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    wrong = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - quality, quality) AS quality", "1 AS toxic")
    a, b = ({r.doc_id: r.score for r in quality.rated(docs, x).collect()} for x in (labels, wrong))
    assert a == b


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(None, 1), (1, 7), (99, 1)], "doc_id long, quality int")
    found = quality.rated(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert quality.rated(none, labels).count() == 0
    assert {r.score for r in quality.rated(odd, labels.where("false")).collect()} == {0.5}
    one_class = labels.where("quality = 1")
    assert {r.score for r in quality.rated(odd, one_class).collect()} == {1.0}
    kept = quality.accepted(odd, quality.fit(odd, one_class))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_a_batch_is_scored_in_slices(spark):
    class Counting(quality.Model):
        def scores(self, texts):
            assert len(texts) <= 1000
            return super().scores(texts)

    docs = spark.range(0, 2500, 1, 1).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    assert [r.score for r in quality.score(docs, Counting(0.25)).collect()] == [0.25] * 2500
    assert quality.accepted(docs, Counting(0.5)).count() == 2500 and quality.accepted(docs, Counting(0.25)).count() == 0
