"""Tokens against the tiktoken library, and round trips."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from jobruns.llm.bpe import Codec, default_tokenizer, read_ranks

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return read_ranks(f.read())


def ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_of_all_kinds(ranks, library):
    rng = random.Random(8)
    texts = ["", " ", "a" * 3000, "ab" * 500, " " * 700, "\n\n \t x", "it's 1234567 don't!!", "漢字かな 👩‍👩‍👧 \u0000", "<|endoftext|>"]
    texts += ["".join(rng.choice("etaoin shrdlu\n'é漢") for _ in range(rng.choice([5, 80, 400]))) for _ in range(60)]
    texts += ["".join(rng.choice("abc") for _ in range(n)) for n in (47, 48, 49, 200)]
    codec = Codec(ranks, PATTERN)
    got = codec.encode(texts)
    assert [ids(g) for g in got] == [library.encode_ordinary(t) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]


def test_other_vocabularies():
    """One where a merge makes a pair of lower rank, which has to be contracted first."""
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"abcabc": 257, b"ab": 258, b"abc": 259, b"aa": 260, b"ca": 255 + 6}
    library = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    codec = Codec(ranks, r"\S+|\s+")
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in [*range(1, 60), 300]]
    assert [ids(g) for g in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_small_cache_and_runs(ranks, library, monkeypatch):
    monkeypatch.setattr("jobruns.llm.bpe.CACHED", 3)
    monkeypatch.setattr("jobruns.llm.bpe.TOKENS_AT_ONCE", 5)
    codec = Codec(ranks, PATTERN)
    for text in ("one two three four five", "six seven one two", "longer text to be decoded in several runs of tokens"):
        (got,) = codec.encode([text])
        assert ids(got) == library.encode_ordinary(text)
        assert codec.decode([got]) == [text.encode()]


def test_rows(odd, none, library):
    tokenizer = default_tokenizer()
    rows = odd.select("doc_id", "text", "lang", "score")
    found = sorted((tuple(r) for r in tokenizer.digests(rows).collect()), key=str)

    def expected(key, text):
        tokens = library.encode_ordinary(text or "")
        packed = b"".join(t.to_bytes(4, "little") for t in tokens)
        return key, len(tokens), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert found == sorted((expected(r.doc_id, r.text) for r in rows.collect()), key=str)
    back = tokenizer.decode(tokenizer.encode(rows)).collect()
    assert sorted((str(r.doc_id), bytes(r.text)) for r in back) == sorted((str(r.doc_id), (r.text or "").encode()) for r in rows.collect())
    assert tokenizer.digests(none).count() == 0


def test_words_met_again_outlast_a_full_cache(ranks, library, monkeypatch):
    monkeypatch.setattr("jobruns.llm.bpe.CACHED", 3)
    contracted = []
    plain = Codec._contract
    monkeypatch.setattr(Codec, "_contract", lambda self, words, sql: contracted.extend(words) or plain(self, words, sql))
    codec = Codec(ranks, PATTERN)
    for i in range(8):
        text = f"qzxqzx a{i}xqj b{i}xqj c{i}xqj d{i}xqj"
        assert ids(codec.encode([text])[0]) == library.encode_ordinary(text)
    assert contracted.count(b"qzxqzx") == 1
    assert len(codec.words) + len(codec.elder) < 60


def test_a_worker_lets_go_of_words_when_its_task_ends(spark):
    from jobruns.llm import bpe

    def held(parts):
        for _ in parts:
            yield pa.record_batch([pa.array([sum(len(c.words) + len(c.elder) for c in bpe._CODECS.values())], pa.int64())], names=["n"])

    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('qzx', id, ' xqj', hex(id)) AS text").repartition(8)
    assert default_tokenizer().digests(docs).count() == 2000
    assert {r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}
