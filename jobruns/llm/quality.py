"""Quality by compression: dictionaries built from good and from bad text, and what each saves.

A text is cut into blocks, so that a block has to be described by the dictionary and not by the text
before it, and every block of the whole text is compressed with either dictionary. The difference of the two
sizes over their sum is calibrated to a probability by logistic regression, with the compressed sizes per
byte beside it (a text that repeats itself is small under any dictionary).

The model is fitted on a bounded sample of labelled rows: at most ``ROWS`` of each class, texts of at most
``SAMPLE_BYTES``, the rows whose ids hash lowest. One half builds the dictionaries, the other calibrates.
Scoring is a single pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobruns.llm.common import filled, id_bucket, table

ROWS, SAMPLE_BYTES = 2000, 32_768
BLOCK, DICTIONARY, LEVEL = 256, 65_536, 3
HELD_OUT, THRESHOLD = 5, 0.3
#: Rows scored at a time.
AT_ONCE = 1000


def _blocks(text: bytes) -> Iterator[bytes]:
    return (text[i : i + BLOCK] for i in range(0, len(text) or 1, BLOCK))


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the blocks of ``texts``; the texts' own end where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, [b for t in texts for b in _blocks(t) if len(b) >= 8]).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(texts) or b"\n" * 8).rjust(8)[-DICTIONARY:]


def _compressor(packed: bytes | None) -> zstandard.ZstdCompressor:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if packed is None:
        return zstandard.ZstdCompressor(**plain)
    trained = zstandard.ZstdCompressionDict(packed)
    trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=trained, **plain)


@dataclass
class Model:
    """Two dictionaries and the calibration. Without both classes to learn from, ``prior`` is every score."""

    prior: float
    good: bytes = b""
    bad: bytes = b""
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, texts: list[bytes]) -> np.ndarray:
        good, bad, plain = _compressor(self.good), _compressor(self.bad), _compressor(None)
        out = np.zeros((len(texts), 4))
        for row, text in zip(out, texts, strict=True):
            g = b = 0
            for block in _blocks(text):
                g += len(good.compress(block))
                b += len(bad.compress(block))
            size = len(text) + 64
            row[:] = (b - g) / (b + g), g / size, len(plain.compress(text)) / size, (b - g) / size
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        x = np.clip((self.features(texts) - self.centre) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-(_terms(x) @ self.weights)))


def _terms(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, x[:, 1:3] ** 2])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * weight.sum() / len(y))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        curve = (x.T * (weight * p * (1 - p))) @ x + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def train(good: list[bytes], bad: list[bytes], counts: tuple[int, int]) -> Model:
    """``counts``: how many labelled rows the two classes have; the sample is weighted to these shares."""
    prior = counts[0] / sum(counts) if sum(counts) else 0.5
    if len(good) < 2 or len(bad) < 2:
        return Model(prior)
    model = Model(prior, dictionary(good[::2]), dictionary(bad[::2]))
    held = [good[1::2], bad[1::2]]
    raw = model.features([t for part in held for t in part])
    y = np.repeat([1.0, 0.0], [len(part) for part in held])
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum()) * len(y)
    model.centre, model.scale = raw.mean(0), raw.std(0) + 1e-9
    x = np.clip((raw - model.centre) / model.scale, -6, 6)
    model.weights = logistic(_terms(x), y, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS) -> Model:
    """The model learnt from labelled rows that are not held out.

    Rows with a null id, a label other than 0 and 1, or without a document take no part; an id repeated with
    one label counts once.
    """
    known = (
        labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where((id_bucket("doc_id", HELD_OUT) != 0) & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
        .distinct()
    )
    sizes = dict(known.groupBy("y").count().collect())
    order = F.xxhash64("doc_id", F.lit(7))
    drawn = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(rows) for y in (1, 0)]
    texts = docs.select(F.col(key).alias("doc_id"), filled(text).cast("binary").alias("text")).where(
        F.octet_length("text") <= SAMPLE_BYTES
    )
    # At most 2 * rows ids, whatever the tables hold.
    sample = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found = sorted(sample.select("y", order.alias("h"), "doc_id", "text").collect(), key=lambda r: (r["h"], r["doc_id"]))
    good, bad = ([bytes(r["text"]) for r in found if r["y"] == y] for y in (1, 0))
    return train(good, bad, (sizes.get(1, 0), sizes.get(0, 0)))


def _slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``AT_ONCE`` rows: of a batch's texts only so many are copied at a time."""
    return (part.slice(i, AT_ONCE) for part in parts for i in range(0, part.num_rows, AT_ONCE))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row; null texts count as empty, and an empty text has a score as well."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            yield pa.record_batch([part.column(0), pa.array(model.scores(part.column(1).to_pylist()))], names=["doc_id", "score"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), filled(text).cast("binary").alias("text"))
    return slim.mapInArrow(batches, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    at = docs.columns.index(text)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            scores = model.scores([(t.as_py() or "").encode() for t in part.column(at)])
            yield part.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(batches, docs.schema)


def rated(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    return score(docs, fit(docs, labels, key, text), key, text).select(
        "doc_id",
        (id_bucket("doc_id", HELD_OUT) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
