"""Raking and sampling against plain Python."""

from collections import defaultdict

import pytest

from jobruns.llm import mixing


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def shares(spark, column, weights):
    return spark.createDataFrame(list(weights.items()), f"{column} string, target double")


def test_margins_are_met(spark):
    rows = [(s, l, t, (i * 37 + j * 11 + k * 5) % 50 + 1) for i, s in enumerate("abcd") for j, l in enumerate("xy") for k, t in enumerate("pq")]
    wanted = {"source": {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, "lang": {"x": 0.25, "y": 0.75}, "topic": {"p": 0.5, "q": 0.5}}
    raked = mixing.rake(cells_of(spark, rows), {c: shares(spark, c, w) for c, w in wanted.items()}).collect()
    for column, weights in wanted.items():
        has = defaultdict(float)
        for r in raked:
            has[r[column]] += r.weight
        assert dict(has) == pytest.approx(weights, abs=1e-8)
    # The odds between cells that share no margin are those of the tokens.
    by = {(r.source, r.lang, r.topic): r.weight / r.tokens for r in raked}
    ratio = by["a", "x", "p"] * by["b", "y", "p"] / (by["a", "y", "p"] * by["b", "x", "p"])
    assert ratio == pytest.approx(1.0, abs=1e-8)


def test_targets_without_cells_and_cells_without_targets(spark):
    rows = [("a", "x", "p", 10), ("b", "x", "p", 30), ("c", "x", "p", 60)]
    targets = {"source": shares(spark, "source", {"a": 0.2, "b": 0.2, "z": 0.6}), "lang": shares(spark, "lang", {"x": 1.0})}
    raked = mixing.rake(cells_of(spark, rows), targets)
    assert {r.source: round(r.weight, 9) for r in raked.collect()} == {"a": 0.5, "b": 0.5, "c": 0.0}


def test_sample_has_the_target_shares(spark):
    rows = [(i, "word " * (1 + i % 7), "en" if i % 5 else "de", "big" if i % 4 else "small") for i in range(8000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    total, taken, source = 0, 0, defaultdict(lambda: [0, 0.0, 0])
    for r in found.collect():
        source[r.source][0] += r.tokens
        source[r.source][1] += r.tokens * r.probability
        source[r.source][2] += r.tokens * r.chosen
        total, taken = total + r.tokens * r.probability, taken + r.tokens * r.chosen
        assert 0 <= r.probability <= 1
    powers = {s: v[0] ** mixing.TEMPERATURES["source"] for s, v in source.items()}
    for s, (_, expected, got) in source.items():
        assert expected / total == pytest.approx(powers[s] / sum(powers.values()), abs=1e-6)
        assert got / taken == pytest.approx(expected / total, abs=0.03)


def test_odd_rows(odd, none):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count()
    assert {r.row.doc_id: r.tokens for r in found if r.row.doc_id in (4, 5, 6)} == {4: 1, 5: 1, 6: 1}
    twice = [r.chosen for r in found if r.row.doc_id == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert mixing.mix(odd).select("row.*").columns == odd.columns
    assert mixing.mix(none).count() == 0


def test_a_stray_row_does_not_thin_out_the_others(spark):
    rows = [(i, "word " * 99, "en" if i % 5 else "de", "big" if i % 4 else "small") for i in range(2000)]
    found = {}
    for stray in ([], [(9999, "just four words here", "en", "odd")]):
        mixed = mixing.mix(spark.createDataFrame(rows + stray, "doc_id long, text string, lang string, source string")).collect()
        found[len(stray)] = sum(r.chosen for r in mixed if r.row.doc_id != 9999) / 2000
        tokens = sum(r.tokens for r in mixed)
        assert sum(r.tokens * r.copies for r in mixed) / tokens == pytest.approx(mixing.SIZE, abs=0.03)
    assert mixed and next(r.copies for r in mixed if r.row.doc_id == 9999) > 1
    assert found[1] == pytest.approx(found[0], abs=0.05) and found[1] > 0.8


def test_target_tables(spark):
    rows = [(i, "word " * 9, "en", "a" if i % 10 else "b") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = defaultdict(int)
    for r in mixing.mix(docs, size=1.0, targets={"source": shares(spark, "source", {"a": 0.5, "b": 0.5})}).collect():
        taken[r.source] += r.tokens * r.copies
    assert taken["a"] / sum(taken.values()) == pytest.approx(0.5, abs=0.02)
    assert sum(taken.values()) == pytest.approx(40_000, rel=0.03)
