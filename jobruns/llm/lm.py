"""Scoring documents with a log-bilinear language model trained by noise-contrastive estimation.

Words fall into a fixed number of classes: the end of a text, the most frequent words (a class each), and the
others by a hash of their last bytes. The model gives the class of a word from the class before it: the score of
a class is the product of a context vector and a target vector, plus a bias. A word has its share of its
class, so the whole is a distribution over all words seen and one unseen word per class.

What is learnt is counted over all training documents by Spark: words, and pairs of neighbouring classes. The
pair counts are the model's sufficient statistic and have a fixed size (``CLASSES`` squared), so training is the same
work whatever the corpus: full-batch descent on the noise-contrastive loss, with the noise taken in
expectation. The scores of all classes in all contexts are one matrix product, normalised by row, and mixed with
the unigram distribution in a proportion chosen on counts set aside.

The most frequent ``COMMON`` words' counts go to every task; the others' are joined. A document's rare words are
counted before they are dealt by word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobruns.llm.common import filled, id_bucket, table, written

HELD_OUT = 10
CLASSES, HEADS, COMMON, SUFFIX = 1024, 512, 200_000, 3
END = 0
WIDTH, NOISE, STEPS, RATE = 32, 25, 240, 0.05
AT_ONCE = 1 << 17


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), filled(text).cast("binary").alias("text"), (id_bucket(key, HELD_OUT) == 0).alias("held_out")
    )


# Counting


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) > AT_ONCE:
                yield out()
                counts.clear()
    yield out()


def word_counts(slim: DataFrame) -> DataFrame:
    """(word, n) over the training documents; ends are not among them."""
    part = slim.where("NOT held_out").select("text").mapInArrow(_count_batches, "word binary, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What tasks need to know of the words: all of it bounded by ``CLASSES`` and ``COMMON``."""

    common: dict[bytes, int]  # counts of the most frequent words
    heads: dict[bytes, int]  # classes of those that have their own
    train_tokens: int
    distinct: int
    ends: int

    def class_of(self, word: bytes) -> int:
        own = self.heads.get(word)
        return own if own is not None else 1 + HEADS + zlib.crc32(word[-SUFFIX:]) % (CLASSES - HEADS - 1)


def vocabulary(counts: DataFrame, training_docs: int) -> Vocabulary:
    """The common words are all those at or above a count; it is read off a histogram of at most 1,024 steps."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    step = F.floor(F.log2("n") * 16)
    cut, held = None, 0
    for at, words in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += words
        if held > COMMON:
            break
        cut = at
    top = counts.where(step >= cut if cut is not None else F.lit(False)).toArrow()
    common = dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))
    heads = sorted(common, key=lambda w: (-common[w], w))[:HEADS]
    return Vocabulary(
        common, {w: i + 1 for i, w in enumerate(heads)}, total + training_docs, distinct + (training_docs > 0), training_docs
    )


class _Classes(dict):
    """Classes by word, worked out once per word; a bounded number is kept."""

    def __init__(self, vocab: Vocabulary) -> None:
        super().__init__(vocab.heads)
        self.vocab = vocab

    def __missing__(self, word: bytes) -> int:
        if len(self) > 2 * AT_ONCE:
            self.clear()
            self.update(self.vocab.heads)
        c = self[word] = self.vocab.class_of(word)
        return c

    def of(self, words: list[bytes]) -> np.ndarray:
        """The classes of the words and of the end."""
        return np.array(list(map(self.__getitem__, words)), np.int32)


def pair_counts(slim: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(before, after, n): how often one class follows another in the training documents."""
    sent = slim.sparkSession.sparkContext.broadcast(vocab)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, n = _Classes(sent.value), np.zeros(CLASSES * CLASSES, np.int64)
        for part in parts:
            for text in part.column(0):
                c = np.concatenate([[END], classes.of(words_of(text.as_py())), [END]])
                np.add.at(n, c[:-1] * CLASSES + c[1:], 1)
        cell = np.nonzero(n)[0]
        for i in range(0, len(cell), AT_ONCE):
            at = cell[i : i + AT_ONCE]
            yield pa.record_batch([pa.array(at // CLASSES), pa.array(at % CLASSES), pa.array(n[at])], names=["before", "after", "n"])

    part = slim.where("NOT held_out").select("text").mapInArrow(batches, "before long, after long, n long")
    return part.groupBy("before", "after").agg(F.sum("n").alias("n"))


# Training


def _descend(counts: np.ndarray, noise: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Scores of classes (columns) after classes (rows), from pair counts, by noise-contrastive estimation.

    The loss of a pair is -log s(d) for the pairs there are and -log s(-d) for ``NOISE`` classes of the noise
    distribution each, with d = score - log(NOISE * noise). Every context is weighed alike in its own step.
    """
    rng = np.random.default_rng(10)
    total = max(counts.sum(), 1.0)
    context = counts.sum(1) / total
    data = (counts / total).astype(np.float32)
    against = (NOISE * context[:, None] * noise[None, :]).astype(np.float32)
    offset = np.log(NOISE * noise).astype(np.float32)
    p = {
        "context": rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32),
        "target": rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32),
        "bias": np.log(noise).astype(np.float32),
        "own": np.zeros((CLASSES, 1), np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    ridge = np.float32(2.0 / total)
    for step in range(1, steps + 1):
        d = p["context"] @ p["target"].T + p["bias"] + p["own"] - offset
        s = 1 / (1 + np.exp(-np.clip(d, -30, 30)))
        g = against * s - data * (1 - s)
        grads = {
            "context": g @ p["target"] + ridge * p["context"],
            "target": g.T @ p["context"] + ridge * p["target"],
            "bias": g.sum(0),
            "own": g.sum(1, keepdims=True),
        }
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, grad in grads.items():
            first[k] += 0.1 * (grad - first[k])
            second[k] += 0.01 * (grad * grad - second[k])
            m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
            p[k] -= rate * m / (np.sqrt(v) + 1e-12)
    return p["context"] @ p["target"].T + p["bias"]


def _normalised(scores: np.ndarray) -> np.ndarray:
    """Probabilities by row."""
    e = np.exp((scores - scores.max(1, keepdims=True)).astype(np.float64))
    return e / e.sum(1, keepdims=True)


def train(counts: np.ndarray) -> np.ndarray:
    """log10 of each class's probability (columns) after each class (rows), from pair counts.

    The share of the unigram distribution is the best of a few on one tenth of the counts, drawn at random, for
    a model of the rest.
    """
    unigram = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * CLASSES)
    aside = np.random.default_rng(11).binomial(counts.astype(np.int64), 0.1)
    tried = _normalised(_descend(counts - aside, unigram, STEPS // 2))
    shares = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 0.95)
    fits = [(aside * np.log(s * unigram + (1 - s) * tried)).sum() for s in shares]
    share = shares[int(np.argmax(fits))]
    return np.log10(share * unigram + (1 - share) * _normalised(_descend(counts, unigram)))


def class_masses(counts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Per class log10 of what the counts plus 0.1 of its words sum to, one unseen word included; 0 for classes of one word."""
    sent = counts.sparkSession.sparkContext.broadcast(vocab)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for part in parts:
            c = np.fromiter((sent.value.class_of(w.as_py()) for w in part.column(0)), np.int64, part.num_rows)
            np.add.at(mass, c, part.column(1).to_numpy())
            np.add.at(words, c, 1)
        yield pa.record_batch([pa.array(np.arange(CLASSES)), pa.array(mass), pa.array(words)], names=["c", "mass", "words"])

    rows = counts.mapInArrow(batches, "c long, mass long, words long").groupBy("c").agg(F.sum("mass"), F.sum("words")).collect()
    out = np.full(CLASSES, 0.1)
    for c, mass, words in rows:
        out[c] = mass + 0.1 * (words + 1)
    out = np.log10(out)
    out[: 1 + HEADS] = 0
    return out


@dataclass
class Model:
    vocab: Vocabulary
    table: np.ndarray  # log10 p(class | class before)
    masses: np.ndarray


def fit(slim: DataFrame, counts: DataFrame) -> Model:
    """The model of the training documents; ``counts`` are their words."""
    vocab = vocabulary(counts, slim.where("NOT held_out").count())
    pairs = pair_counts(slim, vocab).toArrow()
    cells = np.zeros((CLASSES, CLASSES))
    cells[pairs["before"].to_numpy(), pairs["after"].to_numpy()] = pairs["n"].to_numpy()
    return Model(vocab, train(cells), class_masses(counts, vocab))


# Scoring

SCORED = (
    "doc_id long, held_out boolean, text_hash long, n_tokens long, n_common long, rare_tokens long, base_common double, "
    "model_part double, rare array<struct<word: binary, n: long>>"
)
_SCORED_NAMES = ["doc_id", "held_out", "text_hash", "n_tokens", "n_common", "rare_tokens", "base_common", "model_part", "rare"]


class _Scorer:
    """What a task can say of texts: all but the counts of their rare words."""

    def __init__(self, model: Model) -> None:
        self.model, self.classes = model, _Classes(model.vocab)
        self.logs = {w: float(np.log10(n + 0.1)) for w, n in model.vocab.common.items()}

    def score(self, text: bytes) -> tuple[int, int, float, float, Counter[bytes]]:
        """Tokens and common tokens; log10 of the common tokens' counts plus 0.1; the model's part; the rare words."""
        model, words, logs = self.model, words_of(text), self.logs
        before, model_part = END, 0.0
        ends = model.vocab.ends
        n_common, base = int(ends > 0), float(np.log10(ends + 0.1))
        rare: Counter[bytes] = Counter()
        for i in range(0, len(words) + 1, AT_ONCE):
            part = words[i : i + AT_ONCE]
            c = self.classes.of(part)
            own = np.array(list(map(logs.get, part)), np.float64)  # nan for rare words
            known = ~np.isnan(own)
            rare.update(w for w, k in zip(part, known.tolist(), strict=True) if not k)
            n_common += int(known.sum())
            base += float(own[known].sum())
            model_part += float(own[known & (c > HEADS)].sum())
            if i + AT_ONCE > len(words):
                c = np.append(c, np.int32(END))
            model_part += float(model.table[np.concatenate([[before], c[:-1]]), c].sum() - model.masses[c].sum())
            before = c[-1]
        return len(words) + 1, n_common, base, model_part, rare


def _scored(slim: DataFrame, model: Model) -> DataFrame:
    sent = slim.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for part in parts:
            for first in range(0, part.num_rows, 1000):
                rows = part.slice(first, 1000)
                texts = [t.as_py() for t in rows.column(1)]
                n_tokens, n_common, base, model_part, rare = zip(*map(scorer.score, texts), strict=True)
                hashes = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)
                ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
                words = pa.array([w for r in rare for w in r], pa.binary())
                counts = pa.array([n for r in rare for n in r.values()], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([words, counts], ["word", "n"]))
                columns = [
                    rows.column(0), rows.column(2), pa.array(hashes), pa.array(n_tokens, pa.int64()), pa.array(n_common, pa.int64()),
                    pa.array([r.total() for r in rare], pa.int64()), pa.array(base, pa.float64()), pa.array(model_part, pa.float64()), lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_SCORED_NAMES)

    return slim.select("doc_id", "text", "held_out").mapInArrow(batches, SCORED)


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Documents whose id hashes to 0 modulo ``HELD_OUT`` are not learnt from. Null texts count as empty: one token, the
    end. Without training documents every word is unseen and both scores are those of unseen words. Repeated rows
    come back repeated with equal scores; an empty frame gives an empty result.
    """
    slim = _slim(docs, key, text)
    counts = written(word_counts(slim), "words")
    model = fit(slim, counts)
    scored = written(_scored(slim, model), "scored")
    own = ["doc_id", "text_hash"]
    rare = scored.select(*own, F.explode("rare").alias("r")).select(*own, "r.word", F.col("r.n").alias("here"))
    log = F.col("here") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)
    sums = (
        rare.join(counts, "word", "left")
        .groupBy(*own)
        .agg(
            F.sum("here").alias("found"),
            F.sum(log).alias("logs"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("here")).otherwise(0)).alias("known"),
        )
    )
    sums = sums.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "found", "logs", "known")
    both = scored.drop("rare").join(sums, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    # Rows that repeat a document add their rare words to one sum, each the same part of it.
    share = F.col("rare_tokens") / F.col("found")
    vocab = model.vocab
    total = F.log10(F.lit(vocab.train_tokens + 0.1 * (vocab.distinct + 1)))
    rare_logs = F.coalesce(F.col("logs") * share, F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce(F.round(F.col("known") * share), F.lit(0.0))).cast("long").alias("n_known"),
        F.lit(vocab.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_common") + rare_logs - F.col("n_tokens") * total).alias("base_score"),
        (F.col("model_part") + rare_logs).alias("score"),
    )


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
