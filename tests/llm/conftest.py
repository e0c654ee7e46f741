from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, shard int, digest string, word string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, very long and repeated texts, repeated rows, and columns named like the operators' own."""
    prose = " ".join(f"word{i % 97} of{i % 13}" for i in range(400))
    rows = [
        (1, prose, "en", "a"),
        (2, prose + "  ", "en", "a"),
        (2, prose + "  ", "en", "a"),
        (3, prose.upper(), "en", None),
        (4, None, None, None),
        (5, "", "fr", ""),
        (6, " \t\n\r ", "fr", "b"),
        (None, "no id at all", "de", "b"),
        (None, None, None, "b"),
        (7, "éé ñandú 漢字 👩‍👩‍👧 <|endoftext|>", "es", "c"),
        (8, "x" * 60_000, "en", "c"),
        (9, "very long " * 60_000, "en", "c"),
        (10, "Released under the MIT License.\nOne more line.", "en", "c"),
    ]
    full = [(*r, len(r[1] or ""), 1, 0.5, 3, "d", "w") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
