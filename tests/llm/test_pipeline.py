"""The pipeline against its stages done plainly, and on odd tables."""

import hashlib
import re

import corpus_pipeline
from jobruns.llm import mixing, quality
from tests.llm.test_jaccard import plain_pairs
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def plain_groups(texts):
    """The smallest id of each text's group over op1's links and all pairs of five-word similarity 0.8 or more."""
    least = plain_components({i: plain_fingerprint(t) for i, t in texts.items()})
    for a, b in plain_pairs(texts):
        low, high = sorted((least[a], least[b]))
        least = {i: low if root == high else root for i, root in least.items()}
    return least


def test_run_equals_plain_stages(spark):
    """Classifier and mixing are taken from their own tests; what they decide must take effect, and the rest is brute force."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    good = {r.doc_id: r.text for r in corpus_pipeline.good(spark, docs, SF).collect()}
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert set(good) == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    groups = {}
    for i, t in good.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    distinct = {min(m)[1] for m in groups.values()}
    least = plain_groups({i: good[i] for i in distinct})
    different = {i for i in distinct if least[i] == i}
    kept = docs.where(docs.doc_id.isin(sorted(different)))
    chosen = {r.row.doc_id for r in mixing.mix(kept).where("chosen").collect()}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(found) == chosen and chosen
    for i, r in found.items():
        assert r.decoded_sha256 == hashlib.sha256(good[i].encode()).hexdigest()


def test_odd_rows_through_each_stage(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        if name != "encoding":
            assert out.columns == odd.columns and out.dtypes == odd.dtypes
        ids = [r.doc_id for r in out.collect()]
        if name == "exact dedup":  # 2 has more code points than 1, 6 than the other empty ones
            assert sorted(map(str, ids)) == sorted(map(str, [2, 3, 6, None, 7, 8, 9, 10]))
        if name == "near dedup":  # case does not count
            assert sorted(map(str, ids)) == sorted(map(str, [1, 4, None, 7, 8, 9, 10]))
        assert stage(spark, none, str(tmp_path)).count() == 0
